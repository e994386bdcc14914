"""SQL fragments from which the equivalents of the queries are put together."""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the code does not agree with itself.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288)
GREETING_OPENERS = (
    "yo ",
    "hey ",
    "hi ",
    "hello ",
    "greetings",
    "sup ",
    "howdy",
)
DIRECT_ADDRESS = (
    "can you hear me",
    "are you there",
    "how's it going",
    "hows it going",
    "how are you",
    "testing 123",
    "just checking in",
    "first smoke test",
)
BOOKKEEPING_TAGS = (
    "session-notes",
    "session",
    "notes",
    "summary",
    "completion-summary",
    "status",
    "update",
    "wip",
    "todo",
    "misc",
    "general",
    "project-state",
)

WS = "concat(" + ", ".join(f"chr({c})" for c in WHITE_SPACE) + ")"
NL = "chr(10)"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


MEMORIES_RAW = """raw AS (
 SELECT doc_id AS src_ord, concat('docs:', doc_id) AS id,
  CASE WHEN doc_id >= 1000000000 THEN text
       WHEN doc_id % 37 = 0 THEN concat('Hey there! ', text)
       WHEN doc_id % 3 = 0 THEN concat('REFERENCE ', doc_id, chr(10), chr(10), array_to_string(
         list_transform(string_split(text, chr(10)), lambda l, i:
           CASE WHEN (i - 1) % 3 = 0
                THEN concat(CASE WHEN (i - 1) % 2 = 0 THEN '## ' ELSE '### ' END, 'Part ', i - 1,
                            chr(10), chr(10), l)
                ELSE l END), chr(10)))
       ELSE text END AS content,
  CASE doc_id % 6 WHEN 0 THEN 'procedural' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural'
       WHEN 3 THEN 'schematic' WHEN 4 THEN 'semantic' ELSE 'episodic' END AS memory_type,
  string_split(concat(lang, ',', source, CASE WHEN doc_id % 17 = 0 THEN ',A2A' ELSE '' END,
    CASE WHEN doc_id % 19 = 0 THEN concat(',from:', source) ELSE '' END,
    CASE WHEN doc_id % 23 = 0 THEN ',dream_extracted' ELSE '' END), ',') AS tags,
  source AS agent_id,
  CASE WHEN doc_id % 29 <> 0 THEN (doc_id % 100) / 100.0 END AS salience_raw,
  doc_id % 31 = 0 AS deleted
 FROM (SELECT doc_id, text, lang, source FROM documents UNION ALL
  SELECT doc_id + 1000000000, concat('see ', repeat('https://example.com/', 12)), lang, source
  FROM documents WHERE doc_id % 41 = 0))"""

MEMORIES = (
    MEMORIES_RAW
    + """, mem AS (
 SELECT src_ord, id, content, memory_type, tags, agent_id,
        CAST(coalesce(salience_raw, 0.5) AS FLOAT) AS salience
 FROM raw WHERE NOT deleted)"""
)

ROUTING = "(starts_with(lower({x}), 'from:') OR starts_with(lower({x}), 'to:'))"
DENIED = (
    "len(list_filter(tags, lambda g: lower(g) IN "
    "('a2a', 'msg', 'message', 'test', 'smoke', 'chatter', 'ping') OR "
    + ROUTING.format(x="trim(g)")
    + ")) > 0"
)
DREAM = "len(list_filter(tags, lambda g: regexp_matches(lower(trim(g)), '^dream([_-]|$)'))) > 0"


def chatter(x: str) -> str:
    opener = "^(" + "|".join(GREETING_OPENERS) + ")"
    phrases = "|".join(DIRECT_ADDRESS).replace("'", "''")
    return (
        f"(regexp_matches(lower({strip(f'split_part({x}, {NL}, 1)')}), '{opener}') "
        f"OR regexp_matches(lower({x}), '{phrases}'))"
    )


def word_bytes(x: str) -> str:
    return (
        f"strlen(regexp_replace(regexp_replace({x}, '(^|\\s)https?://\\S*', '', 'g'), "
        f"'\\s+', '', 'g'))"
    )


def not_prose(x: str) -> str:
    return (
        f"(length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) * 2 < length({x}) "
        f"OR {word_bytes(x)} < 60)"
    )


def verdict(
    types: str = "'procedural', 'semantic', 'schematic'", min_content: int = 120, dream: bool = True
) -> str:
    return f"""CASE WHEN memory_type NOT IN ({types}) THEN 'type_excluded'
  WHEN length(t) < {min_content} THEN 'too_short'
  WHEN salience < CAST(0.3 AS FLOAT) THEN 'low_salience'
  WHEN {DENIED} THEN 'denied_tag'
  {"WHEN " + DREAM + " THEN 'dream_derived'" if dream else ""}
  WHEN {chatter("t")} THEN 'chatter'
  WHEN {not_prose("t")} THEN 'not_prose' ELSE 'pass' END"""


TRIMMED = MEMORIES + f", tm AS (SELECT *, {strip('content')} AS t FROM mem)"
GATED = TRIMMED + f", gated AS (SELECT *, {verdict()} AS verdict FROM tm)"

HASHES = "length(regexp_extract({x}, '^(#*)', 1))"


def heading_text(x: str) -> str:
    """Text of a line that starts with hashes."""
    rest = strip(f"substr({x}, {HASHES.format(x=x)} + 1)")
    return strip(f"rtrim({rest}, ':')")


def is_heading(x: str) -> str:
    return (
        f"(starts_with({x}, '##') AND {HASHES.format(x=x)} <= 6 AND {heading_text(x)} <> '')"
    )


def labelled(b: str) -> str:
    label = f"split_part({b}, ' — ', 1)"
    return (
        f"(regexp_matches({b}, '(?i)^(procedure[ :—]|architecture decision)') OR "
        f"(contains({b}, ' — ') AND strlen({label}) BETWEEN 1 AND 50 AND {strip(label)} <> '' "
        f"AND NOT ends_with({strip(label)}, '.') "
        f"AND len(regexp_split_to_array({strip(label)}, '\\s+')) <= 8))"
    )


def outline(source: str) -> str:
    """CTEs from ``source(src_ord, t)`` with non-empty trimmed ``t`` to ``sections``."""
    last_pos = ", ".join(
        f"max(CASE WHEN lv = {k} THEN pos END) OVER w AS p{k}, "
        f"last_value(CASE WHEN lv = {k} THEN txt END IGNORE NULLS) OVER w AS x{k}"
        for k in range(2, 7)
    )

    def live(k: int) -> str:
        lower = " AND ".join(f"p{k} > coalesce(p{j}, -1)" for j in range(2, k)) or "true"
        return f"CASE WHEN p{k} IS NOT NULL AND {lower} THEN x{k} END"

    path = "list_filter([" + ", ".join(live(k) for k in range(2, 7)) + "], lambda x: x IS NOT NULL)"
    return f"""
 ti AS (SELECT src_ord, t, f, {strip("ltrim(f, '#')")} AS b
        FROM (SELECT src_ord, t, {strip(f"split_part(t, {NL}, 1)")} AS f FROM {source})),
 titled AS (SELECT src_ord, t, CASE WHEN NOT {is_heading("f")} AND b <> '' AND ({labelled("b")}
        OR (length(b) <= 120 AND (starts_with(f, '#') OR NOT ends_with(b, '.')))) THEN b END
        AS title FROM ti),
 li AS (SELECT src_ord, title, unnest(string_split(replace(t, chr(13) || chr(10), {NL}), {NL})) AS l,
        generate_subscripts(string_split(replace(t, chr(13) || chr(10), {NL}), {NL}), 1) AS pos
        FROM titled),
 lt AS (SELECT *, ltrim(l, {WS}) AS s FROM li WHERE title IS NULL OR pos > 1),
 hd AS (SELECT src_ord, title, l, pos, {is_heading("s")} AS ish,
        CASE WHEN {is_heading("s")} THEN {HASHES.format(x="s")} END AS lv,
        CASE WHEN {is_heading("s")} THEN {heading_text("s")} END AS txt FROM lt),
 tr AS (SELECT *, count(CASE WHEN ish THEN 1 END) OVER w AS sec, {last_pos} FROM hd
        WINDOW w AS (PARTITION BY src_ord ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 trail AS (SELECT src_ord, title, l, pos, ish, lv, txt, sec, {path} AS live FROM tr),
 secs0 AS (SELECT src_ord, sec, any_value(title) AS title,
        {strip(f"coalesce(string_agg(CASE WHEN NOT ish THEN l END, {NL} ORDER BY pos), '')")}
        AS body, any_value(live) AS live, bool_or(sec > 0) AS headed FROM trail
        GROUP BY src_ord, sec),
 sections AS (SELECT src_ord, sec, body,
        list_concat(CASE WHEN title IS NULL THEN CAST([] AS VARCHAR[]) ELSE [title] END, live)
        AS path FROM secs0 WHERE body <> ''
        AND src_ord IN (SELECT src_ord FROM secs0 WHERE headed))"""


def merged(min_section: int = 120) -> str:
    """CTEs from ``sections`` and ``titled`` to ``units``."""
    return f"""
 sn AS (SELECT *, row_number() OVER (PARTITION BY src_ord ORDER BY sec) AS n,
        count(*) OVER (PARTITION BY src_ord) AS total FROM sections),
 mg AS (SELECT src_ord, n, total, body, path FROM sn WHERE n = 1
        UNION ALL
        SELECT s.src_ord, s.n, s.total,
          CASE WHEN length(m.body) < {min_section}
               THEN concat(m.body, chr(10), chr(10), s.body) ELSE s.body END,
          CASE WHEN length(m.body) < {min_section} THEN m.path ELSE s.path END
        FROM mg m JOIN sn s ON s.src_ord = m.src_ord AND s.n = m.n + 1),
 units AS (SELECT src_ord, n, body, path FROM mg WHERE length(body) >= {min_section} OR n = total
        UNION ALL
        SELECT src_ord, 1, t, CASE WHEN title IS NULL THEN CAST([] AS VARCHAR[]) ELSE [title] END
        FROM titled WHERE src_ord NOT IN (SELECT src_ord FROM secs0 WHERE headed))"""


def packed(max_chunk: int = 6000) -> str:
    """CTEs from ``units`` to ``chunks(src_ord, chunk_ix, path, body)``."""
    return f"""
 pa AS (SELECT src_ord, n, unnest(string_split(body, chr(10) || chr(10))) AS p,
        generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS i
        FROM units WHERE length(body) > {max_chunk}),
 pk AS (SELECT src_ord, n, i, p, 1 AS piece, strlen(p) AS held FROM pa WHERE i = 1
        UNION ALL
        SELECT a.src_ord, a.n, a.i, a.p,
          CASE WHEN k.held > 0 AND k.held + 2 + strlen(a.p) > {max_chunk}
               THEN k.piece + 1 ELSE k.piece END,
          CASE WHEN k.held = 0 OR k.held + 2 + strlen(a.p) > {max_chunk}
               THEN strlen(a.p) ELSE k.held + 2 + strlen(a.p) END
        FROM pk k JOIN pa a ON a.src_ord = k.src_ord AND a.n = k.n AND a.i = k.i + 1),
 pieces AS (SELECT src_ord, n, piece,
        {strip("string_agg(p, chr(10) || chr(10) ORDER BY i)")} AS body FROM pk
        GROUP BY src_ord, n, piece),
 ch AS (SELECT src_ord, n, 0 AS piece, path, body FROM units WHERE length(body) <= {max_chunk}
        UNION ALL
        SELECT u.src_ord, u.n, p.piece, u.path, p.body FROM pieces p
        JOIN units u ON u.src_ord = p.src_ord AND u.n = p.n
        WHERE p.body <> '' OR p.piece < (SELECT max(q.piece) FROM pieces q
          WHERE q.src_ord = p.src_ord AND q.n = p.n)),
 chunks AS (SELECT src_ord, row_number() OVER (PARTITION BY src_ord ORDER BY n, piece) - 1
        AS chunk_ix, path, body FROM ch)"""


def tidy(x: str) -> str:
    bare = strip(f"trim({strip(x)}, '`')")
    return strip(f"rtrim({strip(f'regexp_replace({bare}, ' + chr(39) + '^[0-9]+[.] ' + chr(39) + ', ' + chr(39) * 2 + ')')}, ':')")


def statement(x: str) -> str:
    return (
        f"(length({x}) > 40 OR (trim({x}) <> '' AND "
        f"len(regexp_split_to_array(trim({x}), '\\s+')) > 4) OR contains({x}, ', '))"
    )


TOPICAL = (
    "(trim(g) <> '' AND NOT "
    + ROUTING.format(x="trim(g)")
    + f" AND lower(trim(g)) NOT IN ({quoted(BOOKKEEPING_TAGS)})"
    + " AND NOT regexp_matches(lower(trim(g)), '^[0-9/-]+$'))"
)
TOPICAL_TAGS = (
    f"list_transform(list_filter(tags, lambda g: {TOPICAL})[1:3], lambda g: {tidy('g')})"
)


def join_natural(x: str) -> str:
    return (
        f"CASE WHEN len({x}) <= 2 THEN array_to_string({x}, ' and ') ELSE "
        f"concat(array_to_string({x}[1:len({x}) - 1], ', '), ', and ', {x}[len({x})]) END"
    )


def tag_question(x: str = "topical", ending: str = "?") -> str:
    return (
        f"CASE WHEN len({x}) > 0 THEN concat('What do you know about ', {join_natural(x)}, "
        f"'{ending}') END"
    )


def heading_question(p: str = "tp") -> str:
    doc, leaf = f"{p}[1]", f"{p}[len({p})]"
    return f"""CASE WHEN len({p}) = 1 THEN CASE WHEN {statement(doc)}
   THEN concat('Explain: ', {doc}) ELSE concat('Explain ', {doc}, '.') END
  WHEN lower({leaf}) = lower({doc}) THEN concat('Explain ', {doc}, '.')
  WHEN {statement(leaf)} THEN concat('In ', {doc}, ', explain: ', {leaf})
  ELSE concat('Explain ', {leaf}, ', in the context of ', {doc}, '.') END"""


CHUNKED = (
    "WITH RECURSIVE "
    + GATED
    + ", src AS (SELECT src_ord, t FROM gated WHERE verdict = 'pass'),"
    + outline("src")
    + ","
    + merged()
    + ","
    + packed()
)
FRAMED = (
    CHUNKED
    + f""",
 fr AS (SELECT c.src_ord, c.chunk_ix, c.path, c.body, g.id, g.agent_id,
        list_transform(c.path, lambda x: {tidy("x")}) AS tp, {TOPICAL_TAGS} AS topical
        FROM chunks c JOIN gated g ON g.src_ord = c.src_ord),
 framed AS (SELECT *, CASE WHEN len(path) > 0 THEN {heading_question()} ELSE {tag_question()} END
        AS question,
        CASE WHEN len(path) > 0 THEN 'templated_heading' ELSE 'templated_tag' END AS kind
        FROM fr),
 outcome AS (SELECT g.src_ord, g.id, g.agent_id, g.memory_type,
        CASE WHEN g.verdict <> 'pass' THEN g.verdict
             WHEN coalesce(f.n, 0) > 0 THEN 'used' ELSE 'unframeable' END AS verdict,
        coalesce(f.n, 0) AS n_examples, coalesce(f.u, 0) AS n_unframeable
        FROM gated g LEFT JOIN (SELECT src_ord, count(question) AS n,
          count(*) - count(question) AS u FROM framed GROUP BY src_ord) f
        ON f.src_ord = g.src_ord)"""
)
