"""Immutable datasets: ordered text parts, a digest and a sidecar published last."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirloom import __version__
from heirloom.config import USED
from heirloom.operators import examples as ex
from heirloom.schemas import DATASET_META, EXAMPLE
from heirloom.sources.lines import placed, read_lines

# Fixed value: lines per leaf and leaves per branch of the digest tree.
FANOUT = 65536
# Fixed value: names that could leave their directory or hide in it.
INVALID_NAME = r"(?s)^\z|[/\\]|\.\.|^\.|[\x00-\x1f\x7f-\x9f]"


class NoExamples(ValueError):
    """Nothing could be converted; the message says how much was rejected."""


class DatasetExists(ValueError):
    pass


def invalid_name(name: Column) -> Column:
    return name.rlike(INVALID_NAME)


def check_name(name: str) -> str:
    if re.search(INVALID_NAME.replace(r"\z", r"\Z"), name):
        raise ValueError(f"invalid name: {name!r}")
    return name


def data_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{check_name(name)}.jsonl"


def meta_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{check_name(name)}.meta.json"


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


# ------------------------------------------------------------------ digest


def dataset_digest(ordered: DataFrame, position: str = "position", line: str = "line") -> DataFrame:
    """SHA-256 identity of ordered lines as one row ``{sha256, lines}``.

    ``position`` is the dense 0-based line position. Lines are hashed in place,
    65,536 of them to a leaf, 65,536 leaves to a branch, and the branches to the
    identity. Content and order decide it; partitioning and file layout do not,
    and no task ever holds more than one leaf or branch.
    """
    return _tree(ordered.select(F.col(position).alias("_at"), F.sha2(F.col(line), 256).alias("_h")))


def _tree(hashed: DataFrame) -> DataFrame:
    """The identity of ``_at, _h``: places and hashes of lines."""

    def fold(rows: DataFrame, key: Column, order: str) -> DataFrame:
        entries = F.sort_array(F.collect_list(F.struct(order, "_h", "_n")))
        text = F.array_join(F.transform(entries, lambda e: e["_h"]), "")
        return rows.groupBy(key.alias("_key")).agg(
            F.sha2(text, 256).alias("_h"), F.sum("_n").alias("_n")
        )

    leaf_of = F.floor(F.col("_at") / FANOUT).cast("bigint")
    leaves = fold(hashed.withColumn("_n", F.lit(1).cast("bigint")), leaf_of, "_at")
    leaves = leaves.withColumnRenamed("_key", "_ix")
    branch_of = F.floor(F.col("_ix") / FANOUT).cast("bigint")
    branches = fold(leaves, branch_of, "_ix").withColumnRenamed("_key", "_ix")
    root = F.sort_array(F.collect_list(F.struct("_ix", "_h")))
    return branches.agg(
        F.sha2(F.array_join(F.transform(root, lambda e: e["_h"]), ""), 256).alias("sha256"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("lines"),
    )


def dataset_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stored lines with their dense 0-based position across the ordered parts."""
    numbered = placed(read_lines(spark, path), False, "position")
    return numbered.select("position", F.col("value").alias("line"))


def stored_digest(spark: SparkSession, path: str) -> DataFrame:
    """The identity of stored lines, from their bytes as they are.

    A line is hashed in the scan, before anything decodes or strips it; only hashes
    and places go on. The scan does not say whether a part ends with a newline, but
    its size does: lines are one byte short in all where the last one is missing. The
    places of such ends become part of the identity, so a dataset as it was written
    has the plain one.
    """
    lines = read_lines(spark, path, exact=True).select(
        "file_path", "block_start", "row_pos", "file_size",
        F.sha2(F.col("value").cast("binary"), 256).alias("_h"),
        (F.octet_length("value") + 1).alias("_bytes"),
    )
    hashed = placed(lines, False, "_at")
    cut = (
        hashed.groupBy("file_path")
        .agg(F.max("_at").alias("_at"), (F.sum("_bytes") != F.max("file_size")).alias("_cut"))
        .where("_cut")
        .agg(F.array_join(F.sort_array(F.collect_list("_at")), ",").alias("_cuts"))
    )
    one = F.lit(1)
    both = _tree(hashed).withColumn("_one", one).join(cut.withColumn("_one", one), "_one")
    whole = F.when(F.col("_cuts") == "", F.col("sha256")).otherwise(
        F.sha2(F.concat_ws(":", "sha256", "_cuts"), 256)
    )
    return both.select(whole.alias("sha256"), "lines")


# ------------------------------------------------------------------- write


def write_ordered_lines(examples: DataFrame, line: Column, path: str) -> None:
    """Write one line per example in key order; part files follow that order.

    Range partitioning splits at sampled keys, and keys are unique, so no part
    can grow out of proportion.
    """
    (
        examples.select("example_key", line.alias("value"))
        .repartitionByRange("example_key")
        .sortWithinPartitions("example_key")
        .select("value")
        .write.mode("errorifexists")
        .text(path)
    )


def accounting(outcomes: DataFrame) -> DataFrame:
    """The counters of a sidecar in one row and one pass over the outcomes.

    Takes the outcomes of memories (with nested ``framed``) or of rounds.
    """
    used = F.col("verdict") == USED
    if "framed" in outcomes.columns:
        per_row = outcomes.select(
            "verdict",
            "unframeable_chunks",
            F.size(
                F.filter("framed", lambda c: c["instruction_kind"] == "templated_heading")
            ).alias("heading"),
            F.size(
                F.filter("framed", lambda c: c["instruction_kind"] == "templated_tag")
            ).alias("tag"),
            F.lit(0).alias("lived"),
        )
    else:
        per_row = outcomes.select(
            "verdict",
            F.lit(0).alias("unframeable_chunks"),
            F.lit(0).alias("heading"),
            F.lit(0).alias("tag"),
            used.cast("int").alias("lived"),
        )
    by_verdict = per_row.groupBy("verdict").agg(
        F.count("*").alias("n"),
        F.sum("unframeable_chunks").cast("bigint").alias("unframeable_chunks"),
        F.sum("heading").cast("bigint").alias("heading"),
        F.sum("tag").cast("bigint").alias("tag"),
        F.sum("lived").cast("bigint").alias("lived"),
    )
    # At most one row per verdict from here on.
    whole = by_verdict.agg(
        F.coalesce(F.sum(F.when(used, F.col("n"))), F.lit(0)).alias("memories_used"),
        F.coalesce(F.sum(F.when(~used, F.col("n"))), F.lit(0)).alias("rejected_total"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("memories_in"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(~used, F.struct("verdict", "n"))))
        ).alias("rejections"),
        F.coalesce(F.sum("unframeable_chunks"), F.lit(0)).alias("unframeable_chunks"),
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.coalesce(F.sum(c), F.lit(0)).alias("v"))
                for k, c in (
                    ("templated_heading", "heading"),
                    ("templated_tag", "tag"),
                    ("lived_turn", "lived"),
                )
            ]
        ).alias("_framing"),
    )
    framing = F.filter("_framing", lambda e: e["v"] > 0)
    return whole.withColumn("framing", F.map_from_entries(framing)).withColumn(
        "example_count",
        F.aggregate("_framing", F.lit(0).cast("bigint"), lambda a, e: a + e["v"]),
    ).drop("_framing")


def sidecar(
    counters: DataFrame,
    digest: DataFrame,
    name: str,
    source_kind: str,
    query: str | None = None,
    agent_id: str | None = None,
) -> DataFrame:
    """The one-row sidecar from counters and digest, both of one row."""
    one = F.lit(1)
    both = counters.withColumn("_one", one).join(digest.withColumn("_one", one), "_one")
    text = lambda v: F.lit(v).cast("string")
    values = {
        "name": F.lit(name),
        "source": F.struct(
            F.lit(source_kind).alias("kind"),
            text(query).alias("query"),
            text(agent_id).alias("agent_id"),
            F.col("memories_in"),
        ),
        "tool_version": F.lit(__version__),
        "created_at": F.current_timestamp(),
    }
    return both.select(
        *[
            values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in DATASET_META.fields
        ]
    )


def write_dataset(
    root: str,
    name: str,
    outcomes: DataFrame,
    examples: DataFrame,
    source_kind: str,
    query: str | None = None,
    agent_id: str | None = None,
) -> DataFrame:
    """Write a dataset and its sidecar; return the sidecar.

    ``outcomes`` should be materialised: counters and examples both derive from
    it. An existing name is refused, and so is a conversion without examples. The
    sidecar is written last: a dataset without one does not exist for readers.
    """
    spark = outcomes.sparkSession
    data, meta = data_path(root, name), meta_path(root, name)
    if path_exists(spark, data) or path_exists(spark, meta):
        raise DatasetExists(f"dataset exists: {data}")
    counters = accounting(outcomes)
    totals = counters.select("example_count", "rejected_total").first()
    if totals["example_count"] == 0:
        raise NoExamples(f"no examples; {totals['rejected_total']} inputs rejected")
    write_ordered_lines(examples, ex.to_jsonl(), data)
    record = sidecar(counters, stored_digest(spark, data), name, source_kind, query, agent_id)
    record.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", True).json(meta)
    return read_meta(spark, root, name)


# -------------------------------------------------------------------- read


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Stored examples, one per line."""
    return spark.read.schema(EXAMPLE).json(path)


def with_meta_defaults(meta: DataFrame) -> DataFrame:
    """Fill the counters that older sidecars lack."""
    empty = F.expr("cast(map() as map<string, bigint>)")
    return meta.withColumn("framing", F.coalesce("framing", empty)).withColumn(
        "unframeable_chunks", F.coalesce("unframeable_chunks", F.lit(0).cast("bigint"))
    )


def read_meta(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The sidecar of one dataset; a missing one is an error."""
    path = meta_path(root, name)
    if not path_exists(spark, path):
        raise LookupError(f"no dataset {name!r} in {root}")
    return with_meta_defaults(spark.read.schema(DATASET_META).json(path))


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Every sidecar under ``root``, newest first; none for a missing directory."""
    try:
        found = spark.read.schema(DATASET_META).option("multiLine", True).json(
            f"{root.rstrip('/')}/*.meta.json"
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], DATASET_META)
    return with_meta_defaults(found).orderBy(F.col("created_at").desc(), "name")


def verify_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Whether the stored lines still hash to what the sidecar says."""
    claimed = read_meta(spark, root, name).select(
        "name", F.col("sha256").alias("claimed"), F.lit(1).alias("_one")
    )
    actual = stored_digest(spark, data_path(root, name)).select(
        F.col("sha256").alias("actual"), F.lit(1).alias("_one")
    )
    return claimed.join(actual, "_one").select(
        "name", (F.col("claimed") == F.col("actual")).alias("matches")
    )


def inspect_head(examples: DataFrame, n: int = 3) -> DataFrame:
    """The first examples in dataset order."""
    return examples.orderBy("example_key").limit(n)


def provenance_histogram(examples: DataFrame) -> DataFrame:
    """Examples per kind of origin and agent."""
    return examples.groupBy(
        F.col("provenance.kind").alias("kind"), F.col("provenance.agent_id").alias("agent_id")
    ).agg(
        F.count("*").alias("examples"),
        F.count("provenance.memory_id").alias("with_memory"),
    )
