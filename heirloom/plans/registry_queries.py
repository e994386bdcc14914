"""Queries over datasets on disk, the registry, lineage and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirloom.operators import convert, cost, registry
from heirloom.operators import lineage as lin
from heirloom.plans import fixtures as fx
from heirloom.plans import sql as q
from heirloom.plans.registry import query
from heirloom.schemas import MODEL
from heirloom.session import materialize, scratch_path
from heirloom.sinks import dataset as ds
from heirloom.sinks import export
from heirloom.sources.registry import read_records

# ------------------------------------------------------------- equivalents

MODELS = """mo AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS name, c_mktsegment AS base_model,
  concat('trainer', c_nationkey) AS trainer_agent,
  CASE WHEN c_custkey % 13 <> 0 THEN concat('ds', c_custkey % 120) END AS ds_name,
  CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_custkey % 11 = 0 THEN 'stale'
    ELSE sha256(concat('ds', c_custkey % 120)) END END AS ds_sha,
  CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey = 5 THEN '11' WHEN c_custkey % 97 = 0
    THEN 'gone' ELSE CAST(c_custkey // 2 AS VARCHAR) END AS parent,
  1700000000 + (c_custkey * 7919) % 100003 AS created FROM customer)"""
META = """me AS (SELECT concat('ds', s_suppkey) AS name, sha256(concat('ds', s_suppkey)) AS sha,
  s_suppkey % 40 + 1 AS examples, s_suppkey % 17 + 1 AS memories,
  1700000000 + (s_suppkey * 31) % 977 AS created FROM supplier)"""
APPR = """ap AS (SELECT concat('app', p_partkey) AS id, CASE WHEN p_partkey % 4 <> 0
  THEN CAST(p_partkey % 1777 AS VARCHAR) END AS job_id, CASE WHEN p_partkey % 3 <> 0
  THEN CAST(p_partkey * 2 AS VARCHAR) END AS model,
  1700000000 + (p_partkey * 101) % 7919 AS created FROM part)"""
WALK = f"""WITH RECURSIVE {MODELS}, {META}, {APPR}, wk AS (
  SELECT name AS start, 0 AS generation, name AS model, parent, [name] AS seen FROM mo
  UNION ALL SELECT w.start, w.generation + 1, m.name, m.parent, list_append(w.seen, m.name)
  FROM wk w JOIN mo m ON m.name = w.parent WHERE NOT list_contains(w.seen, w.parent)),
 le AS (SELECT start, arg_max(model, generation) AS last_model, max(generation) AS last_generation,
  count(*) AS entries FROM wk GROUP BY start),
 rs AS (SELECT le.*, mo.parent, CASE WHEN mo.parent IS NULL THEN NULL
  WHEN mo.parent NOT IN (SELECT name FROM mo)
  THEN concat('parent "', mo.parent, '" of "', last_model, '" is not in the registry')
  ELSE concat('parent cycle detected at "', mo.parent, '" — a record points back at an ancestor')
  END AS reason FROM le JOIN mo ON mo.name = le.last_model)"""
USED = """um AS (SELECT concat('ds', doc_id % 120) AS dataset, concat('docs:', doc_id) AS memory_id,
  doc_id % 3 + 1 AS n FROM documents)"""
REACHED = f"""{WALK}, {USED}, rc AS (SELECT wk.start, mo.ds_name AS dataset,
  min(wk.generation) AS generation FROM wk JOIN mo ON mo.name = wk.model
  WHERE mo.ds_name IS NOT NULL GROUP BY wk.start, mo.ds_name)"""


# ---------------------------------------------------------------- datasets


def _written(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Convert, write under a fresh root, return the root and the sidecar."""
    root = scratch_path(spark, "datasets")
    outcomes = materialize(convert.convert(fx.memories(spark, sf)), "outcomes")
    meta = ds.write_dataset(
        root, "all", outcomes, convert.examples(outcomes), "snapshot_query", agent_id="all"
    )
    return root, meta


LINES = f"""{q.FRAMED}, lines AS (SELECT src_ord, chunk_ix, kind, concat(
  '{{"messages":[{{"role":"user","content":', CAST(to_json(question) AS VARCHAR),
  '}},{{"role":"assistant","content":', CAST(to_json(body) AS VARCHAR),
  '}}],"provenance":{{"kind":"memory","memory_id":', CAST(to_json(id) AS VARCHAR),
  ',"agent_id":', CAST(to_json(agent_id) AS VARCHAR),
  CASE WHEN len(path) > 0 THEN concat(',"heading_path":', CAST(to_json(path) AS VARCHAR))
  ELSE '' END, '}},"instruction_kind":"', kind, '"}}') AS line,
  concat('{{"messages":[{{"content":', CAST(to_json(question) AS VARCHAR),
  ',"role":"user"}},{{"content":', CAST(to_json(body) AS VARCHAR), ',"role":"assistant"}}]}}')
  AS provider_line FROM framed WHERE question IS NOT NULL)"""


def digest_sql(rows: str) -> str:
    """The digest tree over ``rows(pos, line)``."""
    return f""", h1 AS (SELECT pos, pos // 65536 AS leaf, sha256(line) AS h FROM {rows}),
 h2 AS (SELECT leaf, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM h1 GROUP BY leaf),
 h3 AS (SELECT leaf // 65536 AS branch, sha256(string_agg(h, '' ORDER BY leaf)) AS h FROM h2
   GROUP BY leaf // 65536),
 dg AS (SELECT sha256(string_agg(h, '' ORDER BY branch)) AS sha256 FROM h3)"""


DIGEST = (
    f"{LINES}, ol AS (SELECT row_number() OVER (ORDER BY src_ord, chunk_ix) - 1 AS pos, line "
    f"FROM lines){digest_sql('ol')}"
)


@query(
    "snk1_write_dataset",
    f"{LINES} SELECT count(*) AS lines, count(DISTINCT line) AS distinct_lines FROM lines",
)
def write_dataset(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _written(spark, sf)
    lines = ds.dataset_lines(spark, ds.data_path(root, "all"))
    return lines.groupBy(F.sha2("line", 256)).agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("lines"), F.count("*").alias("distinct_lines")
    )


@query(
    "snk2_write_sidecar",
    f"""{q.FRAMED}, k AS (SELECT count(*) FILTER (kind = 'templated_heading') AS h,
   count(*) FILTER (kind = 'templated_tag') AS t FROM framed WHERE question IS NOT NULL),
  rj AS (SELECT verdict, count(*) AS n FROM outcome WHERE verdict <> 'used' GROUP BY verdict)
  SELECT 'all' AS name, h + t AS example_count,
  (SELECT count(*) FROM outcome WHERE verdict = 'used') AS memories_used,
  (SELECT count(*) FROM outcome WHERE verdict <> 'used') AS rejected_total,
  (SELECT string_agg(concat(verdict, '=', n), ',' ORDER BY verdict) FROM rj) AS rejections,
  h AS framed_heading, t AS framed_tag, (SELECT count(*) FROM outcome) AS memories_in FROM k""",
)
def write_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    _, meta = _written(spark, sf)
    entries = F.sort_array(F.map_entries("rejections"))
    return meta.select(
        "name",
        "example_count",
        "memories_used",
        "rejected_total",
        F.array_join(
            F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
        ).alias("rejections"),
        F.col("framing")["templated_heading"].alias("framed_heading"),
        F.col("framing")["templated_tag"].alias("framed_tag"),
        F.col("source.memories_in").alias("memories_in"),
    )


@query("snk6_dataset_digest", f"{DIGEST} SELECT sha256, (SELECT count(*) FROM ol) AS lines FROM dg")
def dataset_digest(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _written(spark, sf)
    return ds.stored_digest(spark, ds.data_path(root, "all"))


@query(
    "snk6_document_digest",
    "WITH ol AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, text AS line FROM documents)"
    + digest_sql("ol")
    + " SELECT sha256, (SELECT count(*) FROM ol) AS lines FROM dg",
)
def document_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The digest straight from a table whose key is already a dense position."""
    docs = fx.table(spark, sf, "documents")
    return ds.dataset_digest(docs, "doc_id", "text")


@query(
    "snk7_verify_dataset",
    """SELECT * FROM (VALUES ('all', true), ('carriage_return', false), ('one_letter', false),
  ('swapped', false), ('shortened', false)) t(name, matches)""",
)
def verify_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset as it was written, and copies of it that were altered."""
    root, _ = _written(spark, sf)
    lines = ds.dataset_lines(spark, ds.data_path(root, "all"))
    at, line = F.col("position"), F.col("line")
    altered = {
        "carriage_return": (at, F.when(at == 0, F.concat(line, F.lit("\r"))).otherwise(line)),
        "one_letter": (at, F.when(at == 0, F.overlay(line, F.lit("x"), F.lit(3))).otherwise(line)),
        "swapped": (F.when(at < 2, 1 - at).otherwise(at), line),
        "shortened": (at, F.when(at > 0, line)),
    }
    checked = ds.verify_dataset(spark, root, "all")
    meta = spark.read.text(ds.meta_path(root, "all"))
    for name, (order, value) in altered.items():
        copy = lines.select(order.alias("order"), value.alias("value")).where("value IS NOT NULL")
        copy.orderBy("order").select("value").write.text(ds.data_path(root, name))
        meta.write.text(ds.meta_path(root, name))
        checked = checked.unionByName(ds.verify_dataset(spark, root, name).withColumn("name", F.lit(name)))
    return checked


@query(
    "src8_read_dataset",
    f"{LINES} SELECT kind AS instruction_kind, count(*) AS n, "
    "sum(json_array_length(line, '$.messages'))::BIGINT AS messages FROM lines GROUP BY kind",
)
def read_dataset(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _written(spark, sf)
    stored = ds.read_dataset(spark, ds.data_path(root, "all"))
    return stored.groupBy("instruction_kind").agg(
        F.count("*").alias("n"), F.sum(F.size("messages")).cast("bigint").alias("messages")
    )


@query(
    "snk3_export_provider",
    f"{LINES} SELECT row_number() OVER (ORDER BY src_ord, chunk_ix) AS line_no, "
    "md5(provider_line) AS line_md5 FROM lines",
)
def export_provider(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _written(spark, sf)
    out = scratch_path(spark, "export")
    export.export_provider(spark, ds.data_path(root, "all"), out)
    return export.numbered_lines(spark, out).select("line_no", F.md5("line").alias("line_md5"))


@query(
    "snk4_validate_export",
    """SELECT doc_id + 1 AS line_no, CASE doc_id % 9 WHEN 0 THEN 'not a valid stored example'
  WHEN 1 THEN 'no messages' WHEN 2 THEN 'message 1 has empty content'
  WHEN 3 THEN 'no assistant turn — nothing to learn from'
  WHEN 4 THEN 'not a valid stored example' END AS reason
  FROM documents WHERE doc_id % 9 <= 4""",
)
def validate_export(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as stored lines, broken in every way; each break gets its reason."""
    k, text = F.col("doc_id"), F.col("text")

    def line(*messages: tuple[str, object]):
        each = [
            F.struct(F.lit(role).alias("role"), F.lit(body).alias("content"))
            if isinstance(body, str)
            else F.struct(F.lit(role).alias("role"), body.alias("content"))
            for role, body in messages
        ]
        return F.to_json(
            F.struct(
                (F.array(*each) if each else F.array().cast(
                    "array<struct<role: string, content: string>>")).alias("messages"),
                F.struct(F.lit("synthetic").alias("kind"), F.lit("t").alias("template")).alias(
                    "provenance"
                ),
                F.lit("templated_tag").alias("instruction_kind"),
            )
        )

    asked = F.concat(F.lit("Q: "), text)
    stored = (
        F.when(k % 9 == 0, F.concat(F.lit("{"), text))
        .when(k % 9 == 1, line())
        .when(k % 9 == 2, line(("user", asked), ("assistant", " \n ")))
        .when(k % 9 == 3, line(("system", asked), ("user", asked)))
        .when(k % 9 == 4, line(("robot", asked), ("assistant", asked)))
        .when(k % 9 == 5, F.lit("  "))
        .otherwise(line(("user", asked), ("assistant", asked)))
    )
    lines = fx.table(spark, sf, "documents").select(
        (k + 1).alias("line_no"), stored.alias("line")
    )
    return export.violations(lines)


# ---------------------------------------------------------------- registry


@query(
    "src9_read_registry",
    f"WITH {MODELS} SELECT name, ds_name, ds_sha, parent FROM mo",
)
def read_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Record files of a directory, some with one record and some with many; a missing directory is empty."""
    path = scratch_path(spark, "models")
    place = F.xxhash64("name")
    name = F.when(F.pmod(place, F.lit(256)) == 0, F.concat(F.lit("m"), F.col("name"))).otherwise(
        F.concat(F.lit("batch"), F.pmod(place, F.lit(16)).cast("string"))
    )
    records = fx.models(spark, sf).select(F.concat(name, F.lit(".json")).alias("name"), F.to_json(F.struct("*")).alias("r"))
    files = records.groupBy("name").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value"))
    fx.write_files(files.select(F.lit(None).cast("string").alias("folder"), "name", F.lit(0).alias("pos"), "value"), path)
    back = read_records(spark, path, MODEL)
    missing = read_records(spark, path + "/none", MODEL)
    return back.unionByName(missing).select(
        "name", F.col("dataset.name").alias("ds_name"), F.col("dataset.sha256").alias("ds_sha"),
        "parent",
    )


@query(
    "srt2_newest_first",
    f"""WITH {MODELS}, {META}, {APPR}
  SELECT 'model' AS kind, row_number() OVER (ORDER BY created DESC, name) AS place, name AS key FROM mo
  UNION ALL SELECT 'dataset', row_number() OVER (ORDER BY created DESC, name), name FROM me
  UNION ALL SELECT 'apprentice', row_number() OVER (ORDER BY created DESC, id), id FROM ap""",
)
def newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """All records of each kind in order; the order is written out and numbered."""

    def listed(df: DataFrame, kind: str, key: str) -> DataFrame:
        path = scratch_path(spark, "listing")
        registry.newest_first(df, "created_at", key).select(key).write.text(path)
        lines = ds.dataset_lines(spark, path)
        return lines.select(
            F.lit(kind).alias("kind"), (F.col("position") + 1).alias("place"), F.col("line").alias("key")
        )

    return (
        listed(fx.models(spark, sf), "model", "name")
        .unionByName(listed(fx.dataset_meta(spark, sf), "dataset", "name"))
        .unionByName(listed(fx.apprentices(spark, sf), "apprentice", "id"))
    )


RESOLVED = """SELECT mo.name, me.examples AS dataset_examples, me.memories AS dataset_memories,
  mo.ds_name IS NOT NULL AND me.name IS NULL AS dataset_missing,
  coalesce(me.sha <> mo.ds_sha, false) AS dataset_hash_mismatch
  FROM mo LEFT JOIN me ON me.name = mo.ds_name"""


@query("join2_resolve_dataset", f"WITH {MODELS}, {META} {RESOLVED}")
def resolve_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return lin.resolve_dataset(fx.models(spark, sf), fx.dataset_meta(spark, sf)).select(
        "name", "dataset_examples", "dataset_memories", "dataset_missing", "dataset_hash_mismatch"
    )


@query(
    "join3_parent_edge",
    f"WITH {MODELS} SELECT c.name, c.parent FROM mo c JOIN mo p ON p.name = c.parent",
)
def parent_edge(spark: SparkSession, sf: str) -> DataFrame:
    return lin.parent_edges(fx.models(spark, sf)).select("name", "parent")


@query(
    "join4_binding_audit",
    """SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'unbound' WHEN o_orderkey % 17 = 0 THEN 'mismatch'
  ELSE 'bound' END AS binding, concat('ds', o_custkey % 120) AS dataset, count(*) AS n
  FROM orders GROUP BY 1, 2""",
)
def binding_audit(spark: SparkSession, sf: str) -> DataFrame:
    audit = registry.binding_audit(fx.submitted_files(spark, sf), fx.uploads(spark, sf))
    return audit.groupBy("binding", F.col("dataset.name").alias("dataset")).agg(
        F.count("*").alias("n")
    )


@query(
    "join5_dangling_refs",
    f"""WITH {MODELS}, {APPR}, jb AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events)
  SELECT 'apprentice_job' AS kind, id AS record, job_id AS missing FROM ap
    WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT id FROM jb)
  UNION ALL SELECT 'apprentice_model', id, model FROM ap WHERE model IS NOT NULL
    AND model NOT IN (SELECT name FROM mo)
  UNION ALL SELECT 'model_parent', name, parent FROM mo WHERE parent IS NOT NULL
    AND parent NOT IN (SELECT name FROM mo)""",
)
def dangling_refs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fx.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"))
    return registry.dangling_refs(fx.apprentices(spark, sf), fx.models(spark, sf), jobs)


@query(
    "join6_price_band",
    """SELECT p_partkey, CASE WHEN b <= 0 THEN NULL WHEN b <= 16 THEN 0.48 WHEN b <= 69 THEN 1.5
  WHEN b <= 100 THEN 2.9 END::DOUBLE AS usd_per_mtok FROM
  (SELECT p_partkey, (p_partkey % 1300) / 10.0 - 5 AS b FROM part)""",
)
def price_band(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    sized = fx.table(spark, sf, "part").select(
        "p_partkey", ((k % 1300) / 10.0 - 5).alias("params_b")
    )
    return cost.with_price(sized).select("p_partkey", "usd_per_mtok")


@query(
    "join8_apprentice_to_model",
    f"""{WALK} SELECT ap.id AS apprentice, ap.model IS NOT NULL AS trained, wk.generation::BIGINT
  AS generation, wk.model AS ancestor, ap.model IS NULL AS has_note
  FROM ap LEFT JOIN wk ON wk.start = ap.model""",
)
def apprentice_to_model(spark: SparkSession, sf: str) -> DataFrame:
    models = fx.models(spark, sf)
    apprentices = fx.apprentices(spark, sf)
    starts = apprentices.select(F.col("model").alias("start"))
    out = registry.apprentice_lineage(apprentices, models, lin.ancestry(models, starts))
    return out.select(
        "apprentice", "trained", "generation", "ancestor", F.col("note").isNotNull().alias("has_note")
    )


# ----------------------------------------------------------------- lineage


@query(
    "lin1_lineage_walk",
    f"{WALK} SELECT start, generation::BIGINT AS generation, model FROM wk",
)
def lineage_walk(spark: SparkSession, sf: str) -> DataFrame:
    return lin.ancestry(fx.models(spark, sf))


@query(
    "lin1_walk_of_one",
    f"{WALK} SELECT start, generation::BIGINT AS generation, model FROM wk WHERE start = '11'",
)
def walk_of_one(spark: SparkSession, sf: str) -> DataFrame:
    """One model alone; this one runs into a cycle."""
    return lin.walk_from(fx.models(spark, sf), "11")


@query(
    "lin2_cycle_guard",
    f"{WALK} SELECT start, entries FROM rs WHERE reason LIKE 'parent cycle%'",
)
def cycle_guard(spark: SparkSession, sf: str) -> DataFrame:
    models = fx.models(spark, sf)
    ends = lin.incomplete(lin.chain_ends(models), models)
    return ends.where(F.col("reason").startswith("parent cycle")).select("start", "entries")


@query(
    "lin3_incomplete_reason",
    f"{WALK} SELECT start, last_generation::BIGINT AS last_generation, entries, reason FROM rs",
)
def incomplete_reason(spark: SparkSession, sf: str) -> DataFrame:
    models = fx.models(spark, sf)
    return lin.incomplete(lin.chain_ends(models), models)


@query(
    "lin4_dataset_flags",
    f"""{WALK}, rv AS ({RESOLVED}) SELECT wk.start, wk.generation::BIGINT AS generation, wk.model,
  mo.trainer_agent, rv.dataset_examples, rv.dataset_memories, rv.dataset_missing,
  rv.dataset_hash_mismatch FROM wk JOIN mo ON mo.name = wk.model JOIN rv ON rv.name = wk.model""",
)
def dataset_flags(spark: SparkSession, sf: str) -> DataFrame:
    return lin.lineage_all(fx.models(spark, sf), fx.dataset_meta(spark, sf)).select(
        "start",
        "generation",
        "model",
        "trainer_agent",
        "dataset_examples",
        "dataset_memories",
        "dataset_missing",
        "dataset_hash_mismatch",
    )


@query("lin5_unknown_start", "SELECT count(*) AS models, true AS refused FROM customer")
def unknown_start(spark: SparkSession, sf: str) -> DataFrame:
    models = fx.models(spark, sf)
    try:
        lin.walk_from(models, "no-such-model")
        refused = False
    except lin.UnknownModel:
        refused = True
    return models.agg(F.count("*").alias("models")).withColumn("refused", F.lit(refused))


@query("lin6_is_trained", f"WITH {APPR} SELECT id, model IS NOT NULL AS trained FROM ap")
def is_trained(spark: SparkSession, sf: str) -> DataFrame:
    return fx.apprentices(spark, sf).select(
        "id", registry.is_trained(F.col("model")).alias("trained")
    )


@query(
    "lin7_model_to_memories",
    f"""{REACHED} SELECT rc.start, count(DISTINCT um.memory_id) AS memories,
  sum(um.n)::BIGINT AS examples, min(rc.generation)::BIGINT AS nearest
  FROM rc JOIN um ON um.dataset = rc.dataset GROUP BY rc.start""",
)
def model_to_memories(spark: SparkSession, sf: str) -> DataFrame:
    return lin.model_reach(fx.models(spark, sf), fx.used_memories(spark, sf))


@query(
    "lin8_memory_impact",
    f"""{REACHED} SELECT um.memory_id, count(DISTINCT rc.start) AS models,
  count(DISTINCT rc.start) FILTER (rc.generation = 0) AS direct
  FROM rc JOIN um ON um.dataset = rc.dataset GROUP BY um.memory_id""",
)
def memory_impact(spark: SparkSession, sf: str) -> DataFrame:
    return lin.memory_reach(fx.models(spark, sf), fx.used_memories(spark, sf))


@query(
    "lin9_build_apprentice",
    f"{DIGEST} SELECT 'first' AS id, 'ds-first' AS dataset, sha256, false AS trained FROM dg",
)
def build_apprentice(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "nursery")
    registry.create_apprentice(
        spark, root, "first", "all", "First", "everything", "base", "ds-first",
        fx.memories(spark, sf),
    )
    return registry.apprentices(spark, root).select(
        "id",
        F.col("dataset.name").alias("dataset"),
        F.col("dataset.sha256").alias("sha256"),
        registry.is_trained(F.col("model")).alias("trained"),
    )


@query(
    "lin10_lineage_event",
    f"""WITH {MODELS} SELECT name, concat('[nursery:trained] ', name, ' — by ', base_model, chr(10),
  'trainer_agent: ', trainer_agent, CASE WHEN ds_name IS NOT NULL AND ds_sha <> 'stale'
  THEN concat(chr(10), 'dataset: ', ds_name, ' (', ds_sha, ')') ELSE '' END) AS content,
  concat('nursery|nursery:trained|model:', name, CASE WHEN ds_name IS NOT NULL
  THEN concat('|dataset:', ds_name) ELSE '' END) AS tags, 'episodic' AS memory_type FROM mo""",
)
def lineage_event(spark: SparkSession, sf: str) -> DataFrame:
    event = registry.lineage_event(
        F.lit("trained"),
        F.col("name"),
        F.col("dataset.name"),
        F.when(F.col("dataset.sha256") != "stale", F.col("dataset.sha256")),
        F.col("trainer_agent"),
        F.lit("recorder"),
        F.concat(F.lit("by "), F.col("base_model")),
    )
    rows = fx.models(spark, sf).withColumn("e", event)
    return rows.select(
        "name",
        F.col("e.content").alias("content"),
        F.array_join("e.tags", "|").alias("tags"),
        F.col("e.memory_type").alias("memory_type"),
    )


@query(
    "lin11_register_model",
    f"""WITH {MODELS}, {META}, cd AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 10 = 0
   THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 10 = 1 THEN concat('../m', o_orderkey)
   ELSE concat('m', o_orderkey // 4) END AS name, CASE WHEN o_orderkey % 3 <> 0
   THEN concat('ds', o_orderkey % 130) END AS ds, CASE WHEN o_orderkey % 5 = 0 THEN NULL
   WHEN o_orderkey % 7 = 0 THEN 'lost' ELSE CAST(o_custkey AS VARCHAR) END AS parent FROM orders),
  y AS (SELECT cd.*, me.sha, name_of.name IS NOT NULL AS taken, cd.name NOT LIKE '%/%'
   AND (ds IS NULL OR sha IS NOT NULL) AND (cd.parent IS NULL OR known.name IS NOT NULL) AS sound
   FROM cd LEFT JOIN me ON me.name = cd.ds LEFT JOIN mo name_of ON name_of.name = cd.name
   LEFT JOIN mo known ON known.name = cd.parent),
  x AS (SELECT *, min(CASE WHEN sound AND NOT taken THEN ord END) OVER (PARTITION BY name) AS f FROM y)
  SELECT ord, name, sha AS dataset_sha256, CASE WHEN name LIKE '%/%' THEN 'invalid_name'
   WHEN ds IS NOT NULL AND sha IS NULL THEN 'dataset_missing'
   WHEN parent IS NOT NULL AND parent NOT IN (SELECT name FROM mo) THEN 'parent_missing'
   WHEN taken OR ord <> f THEN 'already_exists' END AS refusal FROM x""",
)
def register_model(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    candidates = fx.table(spark, sf, "orders").select(
        o.alias("ord"),
        F.when(o % 10 == 0, c)
        .when(o % 10 == 1, F.concat(F.lit("../m"), o.cast("string")))
        .otherwise(F.concat(F.lit("m"), F.floor(o / 4).cast("string")))
        .alias("name"),
        F.when(o % 3 != 0, F.concat(F.lit("ds"), (o % 130).cast("string"))).alias("dataset_name"),
        F.when(o % 5 == 0, None).when(o % 7 == 0, "lost").otherwise(c).alias("parent"),
    )
    checked = registry.check_registrations(
        candidates, fx.models(spark, sf), fx.dataset_meta(spark, sf), "ord"
    )
    return checked.select("ord", "name", "dataset_sha256", "refusal")


@query(
    "lin12_attach",
    f"""WITH {APPR}, ch AS (SELECT concat('app', user_id) AS id, concat('m', arg_max(event_id,
  event_id)) AS model FROM events GROUP BY user_id)
  SELECT ap.id, coalesce(ch.model, ap.model) AS model FROM ap LEFT JOIN ch ON ch.id = ap.id""",
)
def attach(spark: SparkSession, sf: str) -> DataFrame:
    """Events as model attachments; the last version of each apprentice counts."""
    base = fx.apprentices(spark, sf).withColumn("version", F.lit(-1).cast("bigint"))
    changes = fx.table(spark, sf, "events").select(
        F.concat(F.lit("app"), F.col("user_id").cast("string")).alias("id"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("value"),
        F.col("event_id").alias("version"),
    )
    versions = base.unionByName(registry.append_version(base, changes, "model"))
    return registry.latest_versions(versions).select("id", "model")


@query(
    "job11_registry_name_check",
    """SELECT doc_id, n = '' OR contains(n, '/') OR contains(n, chr(92)) OR contains(n, '..')
  OR starts_with(n, '.') OR regexp_matches(n, '[\\x00-\\x1f\\x7f]') AS invalid FROM
  (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat('.', text)
   WHEN 1 THEN concat(source, '/', lang) WHEN 2 THEN concat(lang, chr(92)) WHEN 3 THEN ''
   WHEN 4 THEN text WHEN 5 THEN concat(lang, '..', source) ELSE source END AS n
   FROM documents)""",
)
def registry_name_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    name = (
        F.when(k % 7 == 0, F.concat(F.lit("."), F.col("text")))
        .when(k % 7 == 1, F.concat("source", F.lit("/"), "lang"))
        .when(k % 7 == 2, F.concat("lang", F.lit("\\")))
        .when(k % 7 == 3, "")
        .when(k % 7 == 4, F.col("text"))
        .when(k % 7 == 5, F.concat("lang", F.lit(".."), "source"))
        .otherwise(F.col("source"))
    )
    return fx.table(spark, sf, "documents").select(
        "doc_id", ds.invalid_name(name).alias("invalid")
    )
