"""Queries over session files: decoding, rounds, licence, verdicts, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heirloom.config import HarvestConfig
from heirloom.functions import secrets
from heirloom.operators import gate, harvest, messages, profile, rounds
from heirloom.plans import fixtures as fx
from heirloom.plans import sql as q
from heirloom.plans.registry import query
from heirloom.session import scratch_path
from heirloom.sources import sessions as src

# Fixed values, written out here so that a wrong pattern in the code does not agree with itself.
SECRETS = (
    ("sk_prefix", r"\bsk-(?:ant-|or-)?[A-Za-z0-9_-]{16,}"),
    ("key_assignment", r"(?:TOGETHER_API_KEY|OPENAI_API_KEY|OAI_API_KEY|ANTHROPIC_API_KEY)\s*[=:]\s*\S+"),
    ("bearer_hex", r"(?i:authorization)\s*:\s*(?i:bearer)\s+[0-9A-Fa-f]{40}"),
    ("token_hex", r"(?i:token)\s*=\s*[\"']?[0-9A-Fa-f]{40}"),
    ("pem_block", r"-----BEGIN [A-Z0-9 ]*(?:KEY|CERTIFICATE)[A-Z ]*-----"),
)

CFG = HarvestConfig(max_tool_result_chars=300, open_prefixes=("qwen-open",), min_token_hex=40)

# ------------------------------------------------------------- equivalents

SID = (
    "CASE conv_id % 100 WHEN 98 THEN CAST(conv_id AS HUGEINT) + 9223372036854775808 "
    "WHEN 99 THEN CAST(conv_id AS HUGEINT) + 4611686018427387904 "
    "ELSE CAST(conv_id AS HUGEINT) END"
)
MSGS = f"""msgs AS (
 SELECT conv_id, CAST({SID} AS VARCHAR) AS session_id, turn, role,
  role <> 'system' AND NOT (conv_id % 23 IN (4, 5, 6) AND turn = 2) AS valid,
  conv_id = 0 OR conv_id % 100 = 98 AS skipped,
  CASE WHEN role = 'user' AND NOT (conv_id % 4 = 1 AND turn % 4 = 2)
        AND NOT (turn = 0 AND (conv_id % 11 = 5 OR conv_id % 13 = 6))
       THEN CASE WHEN turn = 0 AND conv_id % 9 = 4 THEN concat('Hey there ', text) ELSE text END
       END AS utext,
  role = 'user' AND turn = 0 AND conv_id % 11 = 5 AS image,
  CASE WHEN role = 'user' AND turn % 4 = 2 THEN CASE WHEN conv_id % 3 = 0
       THEN concat('{{"chars":', length(text), '}}') ELSE text END END AS tres,
  conv_id % 5 = 0 AS is_error,
  role = 'assistant' AND conv_id % 7 = 0 AS signed,
  CASE WHEN role = 'assistant' AND conv_id % 7 IN (0, 3)
       THEN concat('Thinking:', chr(10), 'Think ', turn) END AS thought,
  CASE WHEN role = 'assistant' AND (turn % 4 = 3 OR (conv_id % 4 = 1 AND turn % 4 = 1))
       THEN concat('🔧 `run`({{"conv":', conv_id, ',"q":', turn, '}})') END AS call,
  CASE WHEN role = 'assistant' AND conv_id % 17 <> 9 THEN concat(text,
       CASE WHEN conv_id % 19 = 3 AND turn % 4 = 1 THEN ' OPENAI_API_KEY=x1' ELSE '' END) END
       AS said
 FROM conversations)"""
STAMPS = f"""st AS (SELECT DISTINCT CAST({SID} AS VARCHAR) AS session_id, conv_id,
  concat('agent', conv_id % 4) AS agent_id,
  CASE conv_id % 5 WHEN 0 THEN 'claude-x' WHEN 1 THEN 'gpt-x' WHEN 2 THEN 'Qwen-Open'
       WHEN 3 THEN 'studio-llm' END AS model,
  CASE WHEN conv_id % 10 = 7 THEN 'open_reasoning' END AS stamped_class
 FROM conversations WHERE conv_id % 3 <> 0)"""
TURNS = f"""WITH {MSGS}, {STAMPS},
 ok AS (SELECT *, utext IS NOT NULL AS opens,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
   FROM msgs WHERE valid AND NOT skipped),
 tn AS (SELECT *, sum(CASE WHEN opens AND rn > 1 THEN 1 ELSE 0 END)
   OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_index FROM ok)"""
_PATTERN = " OR ".join(
    f"regexp_matches(scan, '{p}')".replace("\"'", "\"''") for _, p in SECRETS
)
ROUNDS = f"""{TURNS},
 rd AS (SELECT tn.conv_id, tn.session_id, turn_index,
   coalesce(string_agg(utext, chr(10) ORDER BY turn), '') AS user_text,
   bool_or(image) AS has_image, bool_or(signed) AS signed, max(length(tres)) AS longest,
   count(*) AS n_messages, any_value(st.agent_id) AS agent_id, any_value(st.model) AS model,
   any_value(stamped_class) AS stamped_class
   FROM tn LEFT JOIN st ON st.session_id = tn.session_id
   GROUP BY tn.conv_id, tn.session_id, turn_index),
 lc AS (SELECT *, coalesce(stamped_class, CASE WHEN signed THEN 'closed_hidden'
   WHEN regexp_matches(lower(model), '^(claude-|gpt-|o1-|o3-|o4-|grok-|gemini-)')
   THEN 'closed_hidden' WHEN starts_with(lower(model), 'qwen-open') THEN 'open_reasoning'
   ELSE 'answer_only' END) AS license_class FROM rd),
 pt AS (SELECT tn.conv_id, tn.turn_index, tn.turn, 1 AS k, thought AS s FROM tn JOIN lc
     ON lc.conv_id = tn.conv_id AND lc.turn_index = tn.turn_index
     WHERE thought IS NOT NULL AND license_class = 'open_reasoning'
   UNION ALL SELECT conv_id, turn_index, turn, 2, call FROM tn WHERE call IS NOT NULL
   UNION ALL SELECT conv_id, turn_index, turn, 3, said FROM tn WHERE said IS NOT NULL
   UNION ALL SELECT conv_id, turn_index, turn, 4,
     concat(CASE WHEN is_error THEN '⚠ ' ELSE '↳ ' END, tres) FROM tn WHERE tres IS NOT NULL),
 asst AS (SELECT conv_id, turn_index,
   string_agg(s, chr(10) || chr(10) ORDER BY turn, k) AS assistant FROM pt
   GROUP BY conv_id, turn_index),
 rt AS (SELECT lc.*, coalesce(a.assistant, '') AS assistant,
   concat(user_text, chr(10), coalesce(a.assistant, '')) AS scan
   FROM lc LEFT JOIN asst a ON a.conv_id = lc.conv_id AND a.turn_index = lc.turn_index),
 vd AS (SELECT *, CASE WHEN user_text = '' AND has_image THEN 'image_only'
   WHEN user_text = '' THEN 'empty_assistant' WHEN {q.chatter("user_text")} THEN 'chatter'
   WHEN longest > 300 THEN 'tool_result_too_long' WHEN assistant = '' THEN 'empty_assistant'
   WHEN {_PATTERN} THEN 'secret' ELSE 'used' END AS verdict FROM rt)"""
OUTCOMES = f"""{ROUNDS},
 oc AS (SELECT verdict, license_class, model FROM vd
   UNION ALL SELECT 'unparsable', NULL, NULL FROM msgs WHERE NOT valid AND NOT skipped
   UNION ALL SELECT CASE WHEN conv_id = 0 THEN 'session_zero' ELSE 'spawn' END, NULL, NULL
     FROM (SELECT DISTINCT conv_id FROM msgs WHERE skipped))"""


# ----------------------------------------------------------------- helpers


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    return messages.decode(fx.readable_lines(spark, sf))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return rounds.with_turns(_decoded(spark, sf).where(F.col("role").isNotNull()))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = rounds.round_facts(rounds.message_parts(_numbered(spark, sf)))
    return rounds.with_license(rounds.stamp_sessions(facts, fx.stamps(spark, sf)), CFG)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """All rounds with their text, whatever their verdict."""
    parts = rounds.message_parts(_numbered(spark, sf))
    facts = rounds.stamp_sessions(rounds.round_facts(parts), fx.stamps(spark, sf))
    return rounds.render_rounds(parts, rounds.with_license(facts, CFG), CFG)


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return harvest.outcomes_of(
        fx.readable_lines(spark, sf), fx.session_files(spark, sf), fx.stamps(spark, sf), CFG
    )


def _mined(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    root = scratch_path(spark, "sessions")
    fx.session_folder(spark, sf, root)
    return harvest.mine_sessions(spark, root, CFG)


def _sid():
    return F.col("session_id").cast("string").alias("session_id")


def _turn():
    return F.col("turn_index").cast("bigint").alias("turn_index")


# ----------------------------------------------------------------- sources


@query(
    "src4_read_session_jsonl",
    f"SELECT CAST({SID} AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 "
    "AS position, md5(concat(replace(text, chr(10), ' '), CASE WHEN turn % 3 = 0 THEN chr(13) ELSE '' END, '|')) "
    "AS line_md5 FROM conversations WHERE conv_id <> 0 AND conv_id % 100 <> 98",
)
def read_session_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of session files with an archive: what is read of them, in order; some files are skipped by name."""
    root = scratch_path(spark, "sessions")
    text = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.when(F.col("turn") % 3 == 0, "\r").otherwise(""), F.lit("|\r"))
    fx.session_folder(spark, sf, root, text)
    lines = src.session_lines(spark, src.session_globs(spark, root)).where("line <> ''")
    place = W.partitionBy("file_path").orderBy("block", "pos")
    return lines.select(
        _sid(), (F.row_number().over(place) - 1).cast("bigint").alias("position"), F.md5("line").alias("line_md5")
    )


@query(
    "src5_read_trace_bundle",
    f"""WITH {STAMPS} SELECT concat('node', conv_id // 64) AS node_id, count(*) AS sessions,
  count(model) AS with_model, count(stamped_class) AS with_class FROM st
  GROUP BY conv_id // 64""",
)
def read_trace_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The sidecars of a folder of exports, one folder a host, each on its own; the root has none."""
    root = scratch_path(spark, "exports")
    fx.bundle_folders(spark, sf, root)
    bundles = src.read_bundle(spark, root).unionByName(src.read_bundle(spark, f"{root}/*"))
    return src.stamps(bundles, "node_id").groupBy("node_id").agg(
        F.count("*").alias("sessions"),
        F.count("model").alias("with_model"),
        F.count("stamped_class").alias("with_class"),
    )


@query(
    "src10_node_resolution",
    "SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'given' WHEN conv_id % 3 = 0 THEN "
    "'sidecar' WHEN conv_id % 5 <> 0 THEN concat('host', conv_id) ELSE 'unknown' END AS node_id "
    "FROM conversations",
)
def node_resolution(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    node = src.node_column(
        F.when(c % 4 == 0, "given"),
        F.when(c % 3 == 0, "sidecar"),
        F.when(c % 5 != 0, F.concat(F.lit("/exports/host"), c.cast("string"), F.lit("/"))).otherwise(
            "/"
        ),
    )
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", node.alias("node_id"))


@query("src11_refuse_empty_source", "SELECT count(*) AS rows_in, true AS refused FROM conversations")
def refuse_empty_source(spark: SparkSession, sf: str) -> DataFrame:
    """A directory without session files (the table directory itself) is refused."""
    try:
        src.session_globs(spark, sf)
        refused = False
    except src.NoSessionFiles:
        refused = True
    rows = fx.table(spark, sf, "conversations")
    return rows.agg(F.count("*").alias("rows_in")).withColumn("refused", F.lit(refused))


# ----------------------------------------------------------------- decoding

_NAMES = (
    "CASE conv_id % 6 WHEN 0 THEN concat('session-', conv_id) WHEN 1 THEN concat('', conv_id) "
    "WHEN 2 THEN concat('session-x', conv_id) WHEN 3 THEN concat('session-+', conv_id) "
    "WHEN 4 THEN concat('session-184467440737095516', conv_id % 100 + 10) "
    "ELSE concat('session-session-', conv_id) END"
)


@query(
    "hrv1_session_id",
    f"""SELECT conv_id, turn, CASE WHEN conv_id % 6 IN (0, 1, 3) THEN CAST(conv_id AS VARCHAR)
  WHEN conv_id % 6 = 4 AND conv_id % 100 + 10 <= 15
  THEN concat('184467440737095516', conv_id % 100 + 10) END AS session_id FROM conversations""",
)
def session_id(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    s = c.cast("string")
    name = (
        F.when(c % 6 == 0, F.concat(F.lit("session-"), s))
        .when(c % 6 == 1, s)
        .when(c % 6 == 2, F.concat(F.lit("session-x"), s))
        .when(c % 6 == 3, F.concat(F.lit("session-+"), s))
        .when(
            c % 6 == 4,
            F.concat(F.lit("session-184467440737095516"), (c % 100 + 10).cast("string")),
        )
        .otherwise(F.concat(F.lit("session-session-"), s))
    )
    path = F.concat(F.lit("/in/"), name, F.lit(".jsonl"))
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", src.session_id(path).cast("string").alias("session_id")
    )


@query(
    "hrv2_session_kind",
    f"SELECT CAST({SID} AS VARCHAR) AS session_id, CASE WHEN conv_id = 0 THEN 'session_zero' "
    "WHEN conv_id % 100 = 98 THEN 'spawn' WHEN conv_id % 100 = 99 THEN 'worker' ELSE 'normal' END "
    "AS kind FROM (SELECT DISTINCT conv_id FROM conversations)",
)
def session_kind(spark: SparkSession, sf: str) -> DataFrame:
    return fx.session_files(spark, sf).select(
        _sid(), src.session_kind(F.col("session_id")).alias("kind")
    )


@query(
    "hrv3_parse_messages",
    f"""WITH {MSGS} SELECT session_id, turn AS seq, CASE WHEN valid THEN role END AS role,
  CASE WHEN valid THEN CASE WHEN role = 'user' THEN (utext IS NOT NULL OR image OR
    (turn = 0 AND conv_id % 13 = 6))::INT + (tres IS NOT NULL)::INT + (conv_id % 5 = 2)::INT
    ELSE (thought IS NOT NULL)::INT + (call IS NOT NULL)::INT + 1 END END::BIGINT AS n_blocks
  FROM msgs WHERE NOT skipped""",
)
def parse_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf).select(
        _sid(),
        F.col("pos").alias("seq"),
        "role",
        F.when(F.col("blocks").isNotNull(), F.size("blocks")).cast("bigint").alias("n_blocks"),
    )


@query("hrv4_split_rounds", f"{TURNS} SELECT session_id, turn AS seq, turn_index FROM tn")
def split_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf).select(_sid(), F.col("pos").alias("seq"), _turn())


@query(
    "win1_turn_index",
    "SELECT conv_id, turn, sum(CASE WHEN role = 'user' AND rn > 1 THEN 1 ELSE 0 END) OVER "
    "(PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_index FROM "
    "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)",
)
def turn_index(spark: SparkSession, sf: str) -> DataFrame:
    """The running count alone, over every row of the table."""
    from heirloom.sources.lines import running_total

    rows = fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.floor(F.col("turn") / 4).alias("block"), "role"
    )
    opens = (F.col("role") == "user").cast("int")
    out = running_total(rows, ["conv_id"], "block", ["turn"], opens, "turn_index", True)
    return out.select("conv_id", "turn", "turn_index")


@query("hrv5_user_text", f"{ROUNDS} SELECT session_id, turn_index, md5(user_text) AS text_md5 FROM rt")
def user_text(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select(_sid(), _turn(), F.md5("user_text").alias("text_md5"))


@query(
    "hrv6_image_only",
    f"{ROUNDS} SELECT session_id, turn_index, user_text = '' AS no_user_text, has_image FROM rt",
)
def image_only(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select(
        _sid(), _turn(), (~F.col("has_user_text")).alias("no_user_text"), "has_image"
    )


@query(
    "hrv7_round_chatter",
    f"{ROUNDS} SELECT session_id, turn_index, {q.chatter('user_text')} AS chatter FROM rt",
)
def round_chatter(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select(
        _sid(), _turn(), gate.chatter(F.col("user_text")).alias("chatter")
    )


@query(
    "hrv8_tool_result_too_long",
    f"{ROUNDS} SELECT session_id, turn_index, coalesce(longest > 300, false) AS too_long FROM rt",
)
def tool_result_too_long(spark: SparkSession, sf: str) -> DataFrame:
    over = F.coalesce(F.col("longest_result") > CFG.max_tool_result_chars, F.lit(False))
    return _facts(spark, sf).select(_sid(), _turn(), over.alias("too_long"))


@query(
    "hrv9_value_text",
    f"{TURNS} SELECT session_id, turn AS seq, md5(tres) AS value_md5 FROM tn WHERE tres IS NOT NULL",
)
def value_text(spark: SparkSession, sf: str) -> DataFrame:
    blocks = _decoded(spark, sf).select(
        "session_id", "pos", F.explode_outer("blocks").alias("b")
    )
    return blocks.where(F.col("b.type") == "tool_result").select(
        _sid(), F.col("pos").alias("seq"), F.md5("b.result_text").alias("value_md5")
    )


@query("hrv10_signed_thinking", f"{ROUNDS} SELECT session_id, turn_index, signed FROM rt")
def signed_thinking(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select(_sid(), _turn(), "signed")


@query(
    "hrv11_classify_license",
    f"{ROUNDS} SELECT session_id, turn_index, license_class, model FROM rt",
)
def classify_license(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select(_sid(), _turn(), "license_class", "model")


@query(
    "hrv12_render_assistant",
    f"{ROUNDS} SELECT session_id, turn_index, length(assistant) AS chars, "
    "md5(assistant) AS assistant_md5 FROM rt",
)
def render_assistant(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select(
        _sid(),
        _turn(),
        F.length("assistant").cast("bigint").alias("chars"),
        F.md5("assistant").alias("assistant_md5"),
    )


@query(
    "hrv13_empty_assistant",
    f"{ROUNDS} SELECT session_id, turn_index FROM rt WHERE assistant = ''",
)
def empty_assistant(spark: SparkSession, sf: str) -> DataFrame:
    from heirloom.functions.text import is_blank

    return _texts(spark, sf).where(is_blank(F.col("assistant"))).select(_sid(), _turn())


_NAMED = "CASE " + " ".join(
    f"WHEN regexp_matches(text, '{p}') THEN '{n}'".replace("\"'", "\"''")
    for n, p in SECRETS
) + " END"


@query(
    "hrv14_secret_scan",
    f"SELECT doc_id, {_NAMED} AS pattern_name FROM documents WHERE {_NAMED} IS NOT NULL",
)
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.table(spark, sf, "documents")
    report = secrets.secret_report(F.col("text"), CFG.min_token_hex)
    return (
        docs.where(secrets.looks_like_secret(F.col("text"), CFG.min_token_hex))
        .withColumn("r", report)
        .select("doc_id", F.col("r.pattern_name").alias("pattern_name"))
    )


@query("hrv15_convert_round", f"{ROUNDS} SELECT session_id, turn_index, verdict FROM vd")
def convert_round(spark: SparkSession, sf: str) -> DataFrame:
    out = rounds.assess_rounds(_numbered(spark, sf), fx.stamps(spark, sf), CFG)
    return out.select(_sid(), _turn(), "verdict")


@query("hrv16_mine_sessions", f"{OUTCOMES} SELECT verdict, count(*) AS n FROM oc GROUP BY verdict")
def mine_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A folder with an archive, a sidecar, blank lines and files that are skipped by name."""
    return gate.ledger(_mined(spark, sf)[0])


@query(
    "hrv16_session_examples",
    f"""{ROUNDS} SELECT session_id, turn_index, agent_id, license_class, model,
  md5(concat(user_text, '|', assistant)) AS text_md5 FROM vd WHERE verdict = 'used'""",
)
def session_examples(spark: SparkSession, sf: str) -> DataFrame:
    made = _mined(spark, sf)[1]
    m, p = F.col("messages"), "provenance."
    return made.select(
        F.col(p + "session_id").cast("string").alias("session_id"),
        F.col(p + "turn_index").cast("bigint").alias("turn_index"),
        F.col(p + "agent_id").alias("agent_id"),
        F.col(p + "license_class").alias("license_class"),
        F.col(p + "model").alias("model"),
        F.md5(F.concat(m[0]["content"], F.lit("|"), m[1]["content"])).alias("text_md5"),
    )


@query(
    "join1_stamp_sessions",
    f"""WITH {STAMPS} SELECT CAST({SID.replace("conv_id", "c.conv_id")} AS VARCHAR) AS session_id,
  st.agent_id, st.model, st.stamped_class FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN st ON st.conv_id = c.conv_id""",
)
def stamp_sessions(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.session_files(spark, sf).select("session_id")
    return rounds.stamp_sessions(files, fx.stamps(spark, sf)).select(
        _sid(), "agent_id", "model", "stamped_class"
    )


@query(
    "agg13_license_mix",
    f"""{ROUNDS} SELECT license_class, model, count(*) AS rounds,
  count(*) FILTER (signed AND license_class <> 'closed_hidden') AS overrides
  FROM vd WHERE verdict = 'used' GROUP BY license_class, model""",
)
def license_mix(spark: SparkSession, sf: str) -> DataFrame:
    return profile.license_mix(_outcomes(spark, sf))


@query("agg5_session_accounting", f"{OUTCOMES} SELECT count(*) AS rounds_in, true AS balanced FROM oc")
def session_accounting(spark: SparkSession, sf: str) -> DataFrame:
    report = harvest.summary(_outcomes(spark, sf))
    balanced = F.col("rounds_used") + F.col("rejected") == F.col("rounds_in")
    return report.select("rounds_in", balanced.alias("balanced"))
