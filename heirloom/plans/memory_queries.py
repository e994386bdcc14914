"""Queries over memories: sources, gate, chunks, framing, accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirloom.config import REJECTION_REASONS, FrameConfig, GateConfig
from heirloom.functions import text as t
from heirloom.operators import chunk, convert, cost, frame, gate, profile
from heirloom.operators import examples as ex
from heirloom.operators import lineage as lin
from heirloom.plans import fixtures as fx
from heirloom.plans import sql as q
from heirloom.plans.registry import query
from heirloom.session import materialize, scratch_path
from heirloom.sources import memories as src

# ---------------------------------------------------------------- sources


@query(
    "src1_read_memory_export",
    f"""WITH {q.MEMORIES_RAW}
SELECT row_number() OVER (ORDER BY file, src_ord DESC) - 1 AS src_ord, id, length(content) AS chars, memory_type,
  CASE WHEN src_ord % 5 = 0 THEN 0 ELSE len(tags) END AS n_tags,
  CASE WHEN src_ord % 7 <> 0 THEN agent_id END AS agent_id,
  round(CAST(CAST(coalesce(salience_raw, 0.5) AS FLOAT) AS DOUBLE), 4) AS salience
  FROM (SELECT *, 'x' || 1000 * (src_ord % 13 % 4 + src_ord % 2 + 2) AS file FROM raw)""",
)
def read_memory_export(spark: SparkSession, sf: str) -> DataFrame:
    """Write JSON array files of different sizes with optional members left out, and read them back in order."""
    path = scratch_path(spark, "export")
    k = F.col("src_ord")
    raw = fx.memories_raw(spark, sf)
    record = F.to_json(
        F.struct(
            "id",
            "content",
            "memory_type",
            F.when(k % 5 != 0, F.col("tags")).alias("tags"),
            F.when(k % 7 != 0, F.col("agent_id")).alias("agent_id"),
            F.col("salience_raw").alias("salience"),
        )
    )
    part = F.concat(F.lit("x"), 1000 * (k % 13 % 4 + k % 2 + 2)).alias("part")
    # A file of one array per value of ``part``: the first record opens it and the last one closes it.
    rows = raw.select(part, (-k).alias("at"), record.alias("r"))
    ends = rows.groupBy("part").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    line = F.concat(
        F.when(F.col("at") == F.col("lo"), "[").otherwise(""),
        F.col("r"),
        F.when(F.col("at") == F.col("hi"), "]").otherwise(","),
    )
    rows = rows.join(F.broadcast(ends), "part").select("part", "at", line.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").text(path)
    return src.read_memory_export(spark, path).select(
        "src_ord",
        "id",
        F.length("content").cast("bigint").alias("chars"),
        "memory_type",
        F.size("tags").cast("bigint").alias("n_tags"),
        "agent_id",
        F.round(F.col("salience").cast("double"), 4).alias("salience"),
    )


SNAPSHOT = f"""{q.MEMORIES_RAW}, snap AS (
 SELECT src_ord, id, content, CASE WHEN src_ord % 47 = 0 THEN 'wat' ELSE memory_type END
   AS memory_type, CASE WHEN src_ord % 43 = 0 THEN CAST([] AS VARCHAR[]) ELSE tags END AS tags,
   CASE WHEN src_ord % 59 <> 0 THEN agent_id END AS agent_id, salience_raw, deleted FROM raw),
 live AS (SELECT *, CAST(coalesce(salience_raw, 0.5) AS FLOAT) AS salience FROM snap
   WHERE NOT deleted AND memory_type <> 'wat')"""


@query(
    "src2_read_memory_snapshot",
    f"""WITH {SNAPSHOT} SELECT row_number() OVER (ORDER BY salience_raw DESC NULLS LAST, id) - 1 AS src_ord,
  id, memory_type, len(tags) AS n_tags, agent_id, round(CAST(salience AS DOUBLE), 4) AS salience FROM live
  WHERE agent_id IN ('src3') AND len(list_filter(tags, lambda g: lower(g) IN ('en', 'a2a'))) > 0""",
)
def read_memory_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_snapshot(
        fx.snapshot(spark, sf), src.SnapshotQuery(agent_id="src3", any_tags=("EN", "a2a"))
    )
    return rows.select(
        "src_ord",
        "id",
        "memory_type",
        F.size("tags").cast("bigint").alias("n_tags"),
        "agent_id",
        F.round(F.col("salience").cast("double"), 4).alias("salience"),
    )


@query(
    "src2_unknown_types",
    f"WITH {SNAPSHOT} SELECT count(*) AS unknown_type FROM snap "
    "WHERE NOT deleted AND memory_type = 'wat'",
)
def unknown_types(spark: SparkSession, sf: str) -> DataFrame:
    return src.unknown_type_count(fx.snapshot(spark, sf))


@query(
    "src3_qualify_ids",
    f"WITH {SNAPSHOT} SELECT concat('store-a:', id) AS id, memory_type FROM live",
)
def qualify_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Store a snapshot as Parquet and read it under its file stem."""
    path = scratch_path(spark, "snapshot") + "/store-a.parquet"
    fx.snapshot(spark, sf).write.parquet(path)
    return src.read_snapshot_parquet(spark, path).select("id", "memory_type")


@query(
    "srt1_top_memories",
    f"""WITH {SNAPSHOT} SELECT id, round(CAST(salience AS DOUBLE), 4) AS salience FROM live
  WHERE len(list_filter(tags, lambda g: lower(g) = 'en')) > 0
  ORDER BY salience_raw DESC NULLS LAST, id LIMIT 50""",
)
def top_memories(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_snapshot(
        fx.snapshot(spark, sf), src.SnapshotQuery(any_tags=("en",), limit=50)
    )
    return rows.select("id", F.round(F.col("salience").cast("double"), 4).alias("salience"))


@query(
    "srt1_top_per_store",
    f"""WITH {SNAPSHOT} SELECT agent_id, id FROM live WHERE agent_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY salience_raw DESC NULLS LAST, id) <= 5""",
)
def top_per_store(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_snapshot(fx.snapshot(spark, sf)).where(F.col("agent_id").isNotNull())
    return src.top_per_store(rows, "agent_id", 5).select("agent_id", "id")


@query(
    "set1_union_snapshots",
    f"""WITH {SNAPSHOT}, u AS (SELECT concat('a:', id) AS id, 0 AS store_ix, salience_raw FROM live
  WHERE agent_id = 'src1' UNION ALL
  SELECT concat('b:', id), 1, salience_raw FROM live WHERE agent_id = 'src2' UNION ALL
  SELECT concat('c:', id), 2, salience_raw FROM live WHERE agent_id = 'src1')
 SELECT id, store_ix, row_number() OVER (ORDER BY store_ix, salience_raw DESC NULLS LAST, id) - 1 AS src_ord FROM u""",
)
def union_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.snapshot(spark, sf)
    stores = [("a", table), ("b", table), ("c", table)]
    return src.union_snapshots(stores, ["src1", "src2", "src1"]).select("id", "store_ix", "src_ord")


@query("set2_exclusive_source", f"WITH {SNAPSHOT} SELECT count(*) AS n, 5 AS refused FROM live")
def exclusive_source(spark: SparkSession, sf: str) -> DataFrame:
    """Reads the one source that is named; none, two or three are an error."""
    readers = {"snapshot": lambda: src.read_snapshot(fx.snapshot(spark, sf))}
    refused = 0
    for names in ((), ("export", "snapshot"), ("export", "sessions"), ("snapshot", "sessions"), ("export", "snapshot", "sessions")):
        try:
            src.choose_source(**dict.fromkeys(names, sf))
        except ValueError:
            refused += 1
    rows = readers[src.choose_source(snapshot=sf)]()
    return rows.agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


# ------------------------------------------------------------------- gate


def _gate_flag(name: str, flag: str, condition) -> None:
    sql = f"WITH {q.TRIMMED} SELECT id, {flag} AS hit FROM tm"

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = fx.memories(spark, sf).withColumn("_trimmed", t.strip(F.col("content")))
        return rows.select("id", condition().alias("hit"))


_gate_flag(
    "gate1_type_excluded",
    "memory_type NOT IN ('procedural', 'semantic', 'schematic')",
    lambda: gate.type_excluded(F.col("memory_type")),
)
_gate_flag("gate2_too_short", "length(t) < 120", lambda: gate.too_short(F.col("_trimmed")))
_gate_flag(
    "gate3_low_salience",
    "salience < CAST(0.3 AS FLOAT)",
    lambda: gate.low_salience(F.col("salience")),
)
_gate_flag("gate4_denied_tag", q.DENIED, lambda: gate.denied_tag(F.col("tags")))
_gate_flag("gate5_dream_derived", q.DREAM, lambda: gate.dream_derived(F.col("tags")))
_gate_flag("gate6_chatter", q.chatter("t"), lambda: gate.chatter(F.col("_trimmed")))
_gate_flag("gate7_not_prose", q.not_prose("t"), lambda: gate.not_prose(F.col("_trimmed")))


@query("gate8_assess", f"WITH {q.GATED} SELECT id, verdict FROM gated")
def assess(spark: SparkSession, sf: str) -> DataFrame:
    return gate.with_verdict(fx.memories(spark, sf)).select("id", "verdict")


@query(
    "gate9_rejection_reasons",
    f"""WITH {q.GATED}, r AS (SELECT unnest([{q.quoted(REJECTION_REASONS)}]) AS reason)
  SELECT r.reason, count(g.id) AS n FROM r LEFT JOIN gated g ON g.verdict = r.reason
  GROUP BY r.reason""",
)
def rejection_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return gate.full_ledger(gate.with_verdict(fx.memories(spark, sf)))


@query(
    "gate10_gate_config",
    f"""WITH {q.TRIMMED}, g AS (SELECT {q.verdict("'episodic', 'semantic'", 400, False)} AS verdict
  FROM tm) SELECT verdict, count(*) AS n FROM g GROUP BY verdict""",
)
def gate_config(spark: SparkSession, sf: str) -> DataFrame:
    cfg = GateConfig(
        include_types=GateConfig.parse_types(["Episodic", " semantic"]),
        min_content=400,
        include_dream_derived=True,
    )
    return gate.ledger(gate.with_verdict(fx.memories(spark, sf), cfg))


# ------------------------------------------------------------------ chunks

DOCS = f"{q.MEMORIES}, src AS (SELECT src_ord, {q.strip('content')} AS t FROM mem WHERE {q.strip('content')} <> '')"
OUTLINE = f"WITH {DOCS},{q.outline('src')}"


@query("chk1_document_title", f"{OUTLINE} SELECT src_ord, title FROM titled")
def document_title(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.memories(spark, sf).withColumn("_t", t.strip(F.col("content")))
    return rows.where(F.col("_t") != "").select(
        "src_ord", chunk.document_title(F.col("_t")).alias("title")
    )


# Every line of every document, and leads put before it.
TEXT_LINES = (
    "(SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM "
    "(SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
)
BANNERS = (
    "concat(CASE WHEN (doc_id + i) % 4 = 0 THEN 'Procedure: ' WHEN (doc_id + i) % 4 = 1 THEN "
    "concat(split_part(line, ' ', 1), ' — ') WHEN (doc_id + i) % 4 = 2 THEN "
    "concat(split_part(line, '.', 1), ' — ') ELSE '' END, line)"
)


def _text_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.posexplode(F.split("text", "\n")).alias("i", "line")
    return fx.table(spark, sf, "documents").select("doc_id", lines).withColumn("i", F.col("i").cast("bigint"))


@query(
    "chk2_labelled_banner",
    f"SELECT doc_id, i, {q.labelled('b')} AS banner FROM "
    f"(SELECT doc_id, i, {q.strip(f'split_part({BANNERS}, {q.NL}, 1)')} AS b FROM {TEXT_LINES})",
)
def labelled_banner(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document behind one of four leads."""
    k, dash = F.col("doc_id") + F.col("i"), F.lit(" — ")
    lead = (
        F.when(k % 4 == 0, "Procedure: ")
        .when(k % 4 == 1, F.concat(F.substring_index("line", " ", 1), dash))
        .when(k % 4 == 2, F.concat(F.substring_index("line", ".", 1), dash))
        .otherwise("")
    )
    line = t.first_line(F.concat(lead, F.col("line")))
    return _text_lines(spark, sf).select("doc_id", "i", line.alias("b")).select(
        "doc_id", "i", chunk.is_labelled_banner(F.col("b")).alias("banner")
    )


@query(
    "chk3_heading_of",
    f"""{OUTLINE} SELECT src_ord, pos - CASE WHEN title IS NULL THEN 1 ELSE 2 END AS pos,
  lv AS level, txt AS text FROM hd WHERE ish""",
)
def heading_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk.with_outline(fx.memories(spark, sf), "content")
    exploded = rows.select("src_ord", F.explode_outer("_heads").alias("h"))
    return exploded.where(F.col("h").isNotNull()).select(
        "src_ord",
        F.col("h.pos").cast("bigint").alias("pos"),
        F.col("h.level").cast("bigint").alias("level"),
        F.col("h.text").alias("text"),
    )


_TRAIL = f"{OUTLINE} SELECT src_ord, sec, array_to_string(live, ' > ') AS trail FROM trail WHERE ish"


@query("win2_heading_trail", _TRAIL)
@query("chk4_heading_trail", _TRAIL)
def heading_trail(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk.with_outline(fx.memories(spark, sf), "content")
    trails = chunk.heading_trails(F.col("_heads"))
    return (
        rows.select("src_ord", F.posexplode_outer(trails).alias("sec", "tr"))
        .where(F.col("sec") > 0)
        .select(
            "src_ord",
            F.col("sec").cast("bigint").alias("sec"),
            F.array_join(F.col("tr.text"), " > ").alias("trail"),
        )
    )


@query(
    "chk5_section_flush",
    f"{OUTLINE} SELECT src_ord, array_to_string(path, ' > ') AS path, md5(body) AS body_md5, "
    "length(body) AS chars FROM sections",
)
def section_flush(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk.with_outline(fx.memories(spark, sf), "content").where(F.size("_heads") > 0)
    secs = chunk.sections(F.col("_title"), F.col("_lines"), F.col("_heads"))
    return rows.select("src_ord", F.explode_outer(secs).alias("s")).select(
        "src_ord",
        F.array_join("s.heading_path", " > ").alias("path"),
        F.md5("s.body").alias("body_md5"),
        F.length("s.body").cast("bigint").alias("chars"),
    )


@query(
    "chk6_merge_short_forward",
    f"WITH RECURSIVE {DOCS},{q.outline('src')},{q.merged()} SELECT src_ord, "
    "array_to_string(path, ' > ') AS path, md5(body) AS body_md5 FROM units "
    "WHERE src_ord IN (SELECT src_ord FROM secs0 WHERE headed)",
)
def merge_short_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk.with_outline(fx.memories(spark, sf), "content").where(F.size("_heads") > 0)
    secs = chunk.sections(F.col("_title"), F.col("_lines"), F.col("_heads"))
    merged = rows.withColumn("_secs", secs).withColumn(
        "_units", chunk.merge_short_forward(F.col("_secs"))
    )
    return merged.select("src_ord", F.explode_outer("_units").alias("s")).select(
        "src_ord",
        F.array_join("s.heading_path", " > ").alias("path"),
        F.md5("s.body").alias("body_md5"),
    )


@query(
    "chk7_split_oversized",
    f"""WITH RECURSIVE units AS (SELECT doc_id AS src_ord, 1 AS n, CAST([] AS VARCHAR[]) AS path,
  replace(text, {q.NL}, {q.NL} || {q.NL}) AS body FROM documents),{q.packed()}
  SELECT src_ord, chunk_ix, length(body) AS chars, md5(body) AS body_md5 FROM chunks""",
)
def split_oversized(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.table(spark, sf, "documents")
    unit = F.array(
        F.struct(
            F.array().cast("array<string>").alias("heading_path"),
            F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("body"),
        )
    )
    split = docs.withColumn("_u", unit).withColumn("chunks", chunk.split_oversized(F.col("_u")))
    return chunk.explode_chunks(split, "doc_id").select(
        F.col("doc_id").alias("src_ord"),
        F.col("chunk_ix").cast("bigint").alias("chunk_ix"),
        F.length("body").cast("bigint").alias("chars"),
        F.md5("body").alias("body_md5"),
    )


@query(
    "chk8_chunk",
    f"WITH RECURSIVE {DOCS},{q.outline('src')},{q.merged()},{q.packed()} SELECT src_ord, chunk_ix, "
    "array_to_string(path, ' > ') AS path, md5(body) AS body_md5 FROM chunks",
)
def chunk_all(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.explode_chunks(chunk.with_chunks(fx.memories(spark, sf)), "src_ord").select(
        "src_ord",
        F.col("chunk_ix").cast("bigint").alias("chunk_ix"),
        F.array_join("heading_path", " > ").alias("path"),
        F.md5("body").alias("body_md5"),
    )


# ----------------------------------------------------------------- framing

# Every line of every document, dressed up as a heading.
HEADINGS = (
    "concat(CASE WHEN (doc_id + i) % 3 = 0 THEN concat(doc_id, '. ') WHEN (doc_id + i) % 3 = 1 THEN '`' "
    "ELSE '' END, line, CASE WHEN (doc_id + i) % 3 = 1 THEN '`' WHEN (doc_id + i) % 3 = 2 THEN ':' ELSE '' END)"
)


def _headings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") + F.col("i")
    return _text_lines(spark, sf).select(
        "doc_id",
        "i",
        F.concat(
            F.when(k % 3 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(". ")))
            .when(k % 3 == 1, "`")
            .otherwise(""),
            "line",
            F.when(k % 3 == 1, "`").when(k % 3 == 2, ":").otherwise(""),
        ).alias("h"),
    )


@query(
    "frm1_tidy",
    f"SELECT doc_id, i, {q.tidy('h')} AS tidied FROM (SELECT doc_id, i, {HEADINGS} AS h FROM {TEXT_LINES})",
)
def tidy(spark: SparkSession, sf: str) -> DataFrame:
    return _headings(spark, sf).select("doc_id", "i", frame.tidy(F.col("h")).alias("tidied"))


@query(
    "frm2_is_statement",
    f"SELECT doc_id, i, {q.statement('h')} AS statement FROM "
    f"(SELECT doc_id, i, {HEADINGS} AS h FROM {TEXT_LINES})",
)
def is_statement(spark: SparkSession, sf: str) -> DataFrame:
    return _headings(spark, sf).select(
        "doc_id", "i", frame.is_statement(F.col("h")).alias("statement")
    )


RICH_TAGS = (
    "list_concat(tags, [CASE WHEN src_ord % 2 = 0 THEN 'notes' ELSE 'mesh' END, "
    "CASE WHEN src_ord % 3 = 0 THEN '2024-2026' ELSE '1. `beacon`' END, 'WIP', ' to:all'])"
)


def _rich_tags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("src_ord")
    extra = F.array(
        F.when(k % 2 == 0, "notes").otherwise("mesh"),
        F.when(k % 3 == 0, "2024-2026").otherwise("1. `beacon`"),
        F.lit("WIP"),
        F.lit(" to:all"),
    )
    return fx.memories(spark, sf).withColumn("tags", F.concat("tags", extra))


_RICH = f"WITH {q.MEMORIES}, rt AS (SELECT * REPLACE ({RICH_TAGS} AS tags) FROM mem)"


@query(
    "frm3_is_topical",
    f"{_RICH} SELECT id, array_to_string(list_filter(tags, lambda g: {q.TOPICAL}), '|') AS topical "
    "FROM rt",
)
def is_topical(spark: SparkSession, sf: str) -> DataFrame:
    return _rich_tags(spark, sf).select(
        "id", F.array_join(F.filter("tags", frame.is_topical), "|").alias("topical")
    )


@query(
    "frm4_join_natural",
    f"{_RICH} SELECT id, {q.join_natural('s')} AS joined FROM "
    "(SELECT id, tags[1:1 + src_ord % 4] AS s FROM rt)",
)
def join_natural(spark: SparkSession, sf: str) -> DataFrame:
    items = F.slice("tags", F.lit(1), (1 + F.col("src_ord") % 4).cast("int"))
    return _rich_tags(spark, sf).select("id", frame.join_natural(items).alias("joined"))


@query(
    "frm5_from_tags",
    f"{_RICH} SELECT id, {q.tag_question(ending=' in Atlas?')} AS question FROM "
    f"(SELECT id, {q.TOPICAL_TAGS} AS topical FROM rt)",
)
def from_tags(spark: SparkSession, sf: str) -> DataFrame:
    cfg = FrameConfig(domain="Atlas")
    return _rich_tags(spark, sf).select(
        "id", frame.from_tags(F.col("tags"), cfg).alias("question")
    )


@query(
    "frm6_instruction_for",
    f"{q.FRAMED} SELECT src_ord, chunk_ix, question, CASE WHEN question IS NOT NULL THEN kind END "
    "AS kind FROM framed",
)
def instruction_for(spark: SparkSession, sf: str) -> DataFrame:
    gated = gate.with_verdict(fx.memories(spark, sf)).where(F.col("verdict") == "pass")
    rows = chunk.explode_chunks(chunk.with_chunks(gated), "src_ord", "tags")
    asked = rows.withColumn("question", frame.instruction(F.col("heading_path"), F.col("tags")))
    return asked.select(
        "src_ord",
        F.col("chunk_ix").cast("bigint").alias("chunk_ix"),
        "question",
        F.when(
            F.col("question").isNotNull(), frame.instruction_kind(F.col("heading_path"))
        ).alias("kind"),
    )


@query(
    "frm7_build_example",
    f"""{q.FRAMED} SELECT src_ord, chunk_ix, 'user' AS first_role, question, 'assistant' AS last_role,
  md5(body) AS body_md5, id AS memory_id, agent_id,
  CASE WHEN len(path) > 0 THEN array_to_string(path, ' > ') END AS heading_path
  FROM framed WHERE question IS NOT NULL""",
)
def build_example(spark: SparkSession, sf: str) -> DataFrame:
    made = convert.examples(convert.convert(fx.memories(spark, sf)))
    m = F.col("messages")
    return made.select(
        F.col("example_key.src_ord").alias("src_ord"),
        F.col("example_key.ix").cast("bigint").alias("chunk_ix"),
        m[0]["role"].alias("first_role"),
        m[0]["content"].alias("question"),
        m[1]["role"].alias("last_role"),
        F.md5(m[1]["content"]).alias("body_md5"),
        F.col("provenance.memory_id").alias("memory_id"),
        F.col("provenance.agent_id").alias("agent_id"),
        F.array_join("provenance.heading_path", " > ").alias("heading_path"),
    )


@query(
    "frm8_convert",
    f"{q.FRAMED} SELECT id AS memory_id, verdict, n_examples AS examples, "
    "n_unframeable AS unframeable_chunks FROM outcome",
)
def convert_all(spark: SparkSession, sf: str) -> DataFrame:
    return convert.convert(fx.memories(spark, sf)).select(
        "memory_id",
        "verdict",
        F.size("framed").cast("bigint").alias("examples"),
        "unframeable_chunks",
    )


@query(
    "frm9_example_to_json",
    f"""{q.FRAMED} SELECT src_ord, chunk_ix, md5(concat(
  '{{"messages":[{{"role":"user","content":', CAST(to_json(question) AS VARCHAR),
  '}},{{"role":"assistant","content":', CAST(to_json(body) AS VARCHAR),
  '}}],"provenance":{{"kind":"memory","memory_id":', CAST(to_json(id) AS VARCHAR),
  ',"agent_id":', CAST(to_json(agent_id) AS VARCHAR),
  CASE WHEN len(path) > 0 THEN concat(',"heading_path":', CAST(to_json(path) AS VARCHAR))
  ELSE '' END,
  '}},"instruction_kind":"', kind, '"}}')) AS line_md5 FROM framed WHERE question IS NOT NULL""",
)
def example_to_json(spark: SparkSession, sf: str) -> DataFrame:
    made = convert.examples(convert.convert(fx.memories(spark, sf)))
    return made.select(
        F.col("example_key.src_ord").alias("src_ord"),
        F.col("example_key.ix").cast("bigint").alias("chunk_ix"),
        F.md5(ex.to_jsonl()).alias("line_md5"),
    )


# -------------------------------------------------------------- accounting


@query(
    "agg1_rejection_ledger",
    f"{q.FRAMED} SELECT verdict, count(*) AS n FROM outcome GROUP BY verdict",
)
def rejection_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return gate.ledger(convert.convert(fx.memories(spark, sf)))


@query("gate_ledger", f"WITH {q.GATED} SELECT verdict, count(*) AS n FROM gated GROUP BY verdict")
def gate_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return gate.ledger(gate.with_verdict(fx.memories(spark, sf)))


@query(
    "agg2_framing_split",
    f"{q.FRAMED} SELECT kind AS instruction_kind, count(*) AS n FROM framed "
    "WHERE question IS NOT NULL GROUP BY kind",
)
def framing_split(spark: SparkSession, sf: str) -> DataFrame:
    return convert.framing_split(convert.convert(fx.memories(spark, sf)))


@query(
    "agg3_memories_used",
    f"{q.FRAMED} SELECT count(*) AS memories_in, count(*) FILTER (verdict = 'used') AS used, "
    "count(*) FILTER (verdict = 'unframeable') AS unframeable FROM outcome",
)
def memories_used(spark: SparkSession, sf: str) -> DataFrame:
    return convert.convert(fx.memories(spark, sf)).agg(
        F.count("*").alias("memories_in"),
        F.count_if(F.col("verdict") == "used").alias("used"),
        F.count_if(F.col("verdict") == "unframeable").alias("unframeable"),
    )


_UNTAGGED = q.FRAMED.replace("SELECT src_ord, id, content, memory_type, tags, agent_id,", "SELECT src_ord, id, content, "
    "memory_type, CASE WHEN src_ord % 2 = 0 THEN ['notes'] ELSE tags END AS tags, agent_id,")  # fmt: skip


@query(
    "agg4_unframeable_chunks",
    f"{_UNTAGGED} SELECT memory_type, sum(n_unframeable)::BIGINT AS unframeable_chunks, "
    "count(*) FILTER (verdict = 'unframeable') AS memories FROM outcome GROUP BY memory_type",
)
def unframeable_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Half the memories have bookkeeping tags alone, so their untitled text stays unframed."""
    notes = F.when(F.col("src_ord") % 2 == 0, F.array(F.lit("notes"))).otherwise(F.col("tags"))
    rows = fx.memories(spark, sf).withColumn("tags", notes)
    kinds = rows.select(F.col("id").alias("memory_id"), "memory_type")
    return convert.convert(rows).join(kinds, "memory_id").groupBy("memory_type").agg(
        F.sum("unframeable_chunks").alias("unframeable_chunks"),
        F.count_if(F.col("verdict") == "unframeable").alias("memories"),
    )


@query(
    "agg5_accounting_check",
    f"WITH {q.MEMORIES} SELECT count(*) AS memories_in, true AS balanced FROM mem",
)
def accounting_check(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs are counted apart from the conversion; both must agree."""
    rows = fx.memories(spark, sf)
    inputs = rows.agg(F.count("*").alias("memories_in")).withColumn("_one", F.lit(1))
    report = convert.summary(convert.convert(rows)).select(
        (F.col("memories_used") + F.col("rejected")).alias("accounted"), F.lit(1).alias("_one")
    )
    return inputs.join(report, "_one").select(
        "memories_in", (F.col("memories_in") == F.col("accounted")).alias("balanced")
    )


@query(
    "snk5_dry_run_summary",
    f"""{q.FRAMED} SELECT count(*) AS memories_in, count(*) FILTER (verdict = 'used')
  AS memories_used, sum(n_examples)::BIGINT AS examples,
  count(*) FILTER (verdict <> 'used') AS rejected,
  sum(n_unframeable)::BIGINT AS unframeable_chunks,
  (SELECT count(*) FROM framed WHERE question IS NOT NULL AND kind = 'templated_heading')
  AS framed_heading,
  (SELECT count(*) FROM framed WHERE question IS NOT NULL AND kind = 'templated_tag')
  AS framed_tag FROM outcome""",
)
def dry_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return convert.summary(convert.convert(fx.memories(spark, sf)))


@query(
    "agg6_agents",
    f"WITH {SNAPSHOT} SELECT coalesce(agent_id, '(none)') AS agent, count(*) AS memories FROM snap "
    "WHERE NOT deleted GROUP BY 1",
)
def agents(spark: SparkSession, sf: str) -> DataFrame:
    return profile.agents(src.live_rows(fx.snapshot(spark, sf)))


@query(
    "agg9_store_profile",
    f"WITH {q.MEMORIES} SELECT memory_type, count(*) AS n, round(avg(length(content)), 6) "
    "AS avg_chars, count(*) FILTER (regexp_matches(content, '(?m)^\\s*##')) AS sectioned "
    "FROM mem GROUP BY memory_type",
)
def store_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.store_profile(fx.memories(spark, sf)).withColumn(
        "avg_chars", F.round("avg_chars", 6)
    )


@query(
    "agg10_dream_vs_lived",
    f"WITH {q.MEMORIES} SELECT {q.DREAM} AS dream, count(*) AS n, round(avg(length(content)), 6) "
    "AS avg_chars FROM mem GROUP BY 1",
)
def dream_vs_lived(spark: SparkSession, sf: str) -> DataFrame:
    return profile.dream_vs_lived(fx.memories(spark, sf)).withColumn(
        "avg_chars", F.round("avg_chars", 6)
    )


@query(
    "agg11_provenance_histogram",
    f"{q.FRAMED} SELECT 'memory' AS kind, agent_id, count(*) AS examples, count(*) AS with_memory "
    "FROM framed WHERE question IS NOT NULL GROUP BY agent_id",
)
def provenance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    from heirloom.sinks.dataset import provenance_histogram as histogram

    return histogram(convert.examples(convert.convert(fx.memories(spark, sf))))


@query(
    "agg12_estimate",
    f"""{q.FRAMED}, ds AS (SELECT agent_id AS dataset, sum(length(question) + length(body))
  AS chars, 10.0 * CAST(substr(agent_id, 4) AS INT) AS params_b FROM framed
  WHERE question IS NOT NULL GROUP BY agent_id)
  SELECT dataset, CAST(ceil(chars / 4.0) AS BIGINT) AS dataset_tokens,
  3 * CAST(ceil(chars / 4.0) AS BIGINT) AS training_tokens,
  round(3 * ceil(chars / 4.0) / 1e6 * CASE WHEN params_b <= 0 THEN NULL WHEN params_b <= 16
  THEN 0.48 WHEN params_b <= 69 THEN 1.5 WHEN params_b <= 100 THEN 2.9 END, 8) AS training_usd
  FROM ds""",
)
def estimate(spark: SparkSession, sf: str) -> DataFrame:
    made = convert.examples(convert.convert(fx.memories(spark, sf)))
    sizes = (
        made.groupBy(F.col("provenance.agent_id").alias("dataset"))
        .agg(F.sum(cost.message_chars(F.col("messages"))).alias("chars"))
        .withColumn("params_b", F.substring("dataset", 4, 10).cast("int") * F.lit(10.0))
    )
    return cost.estimate(sizes, epochs=3).select(
        "dataset",
        "dataset_tokens",
        "training_tokens",
        F.round("training_usd", 8).alias("training_usd"),
    )


@query(
    "srt4_stable_order",
    f"{q.FRAMED} SELECT row_number() OVER (ORDER BY src_ord, chunk_ix) - 1 AS position, "
    "src_ord, chunk_ix FROM framed WHERE question IS NOT NULL",
)
def stable_order(spark: SparkSession, sf: str) -> DataFrame:
    """Position of each example in the written dataset, from the written files."""
    from heirloom.sinks import dataset as ds

    # Written first: a range sort samples its input and would convert everything twice.
    made = convert.examples(materialize(convert.convert(fx.memories(spark, sf)), "outcomes"))
    path = scratch_path(spark, "ordered")
    ds.write_ordered_lines(made, F.to_json("example_key"), path)
    key = F.from_json("line", "src_ord BIGINT, ix BIGINT")
    return ds.dataset_lines(spark, path).select(
        "position", key["src_ord"].alias("src_ord"), key["ix"].alias("chunk_ix")
    )


@query(
    "srt3_inspect_head",
    f"{q.FRAMED} SELECT src_ord, chunk_ix, question FROM framed WHERE question IS NOT NULL "
    "ORDER BY src_ord, chunk_ix LIMIT 3",
)
def inspect_head(spark: SparkSession, sf: str) -> DataFrame:
    from heirloom.sinks.dataset import inspect_head as head

    made = convert.examples(convert.convert(fx.memories(spark, sf)))
    return head(made, 3).select(
        F.col("example_key.src_ord").alias("src_ord"),
        F.col("example_key.ix").cast("bigint").alias("chunk_ix"),
        F.col("messages")[0]["content"].alias("question"),
    )


@query(
    "join7_examples_to_memories",
    f"{q.FRAMED} SELECT g.memory_type, count(*) AS examples, count(DISTINCT g.id) AS memories "
    "FROM framed f JOIN gated g ON g.id = f.id WHERE f.question IS NOT NULL GROUP BY g.memory_type",
)
def examples_to_memories(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.memories(spark, sf)
    made = convert.examples(convert.convert(rows)).select("provenance")
    joined = lin.examples_to_memories(made, rows.select("id", "memory_type"))
    per_memory = joined.groupBy("memory_type", "memory_id").agg(F.count("*").alias("n"))
    return per_memory.groupBy("memory_type").agg(
        F.sum("n").alias("examples"), F.count("*").alias("memories")
    )


