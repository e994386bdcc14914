"""Memories from JSON exports and from snapshot tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heirloom.config import MEMORY_TYPES
from heirloom.functions.text import strict_json
from heirloom.schemas import MEMORY_EXPORT, STRINGS
from heirloom.sources.lines import placed, ranked

DEFAULT_SALIENCE = 0.5
MEMORY_COLUMNS = ["id", "content", "memory_type", "tags", "agent_id", "salience"]


def with_defaults(rows: DataFrame) -> DataFrame:
    """Fill what an export may leave out."""
    return rows.select(
        "id",
        "content",
        "memory_type",
        F.coalesce("tags", F.array().cast(STRINGS)).alias("tags"),
        "agent_id",
        F.coalesce("salience", F.lit(DEFAULT_SALIENCE).cast("float")).alias("salience"),
        *[c for c in rows.columns if c not in MEMORY_COLUMNS],
    )


def read_memory_export(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Memories from files that each hold one JSON array.

    A record without id, content or a known type makes the read fail, as does a
    file that is not JSON. Adds ``file_path`` and ``src_ord``, the dense place of the
    record: files in the order of their paths, records as they stand in a file. The
    records are parsed and written once (see ``lines.placed``).
    """
    return _in_source_order(spark.read.option("multiLine", True), path)


def read_memory_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same records one per line: the splittable form for large exports."""
    return _in_source_order(spark.read, path)


def _in_source_order(reader: DataFrameReader, path: str | list[str]) -> DataFrame:
    raw = reader.schema(MEMORY_EXPORT).option("mode", "FAILFAST").json(path)
    raw = raw.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_pos"),
    )
    rows = placed(with_defaults(_require_export_fields(raw)), False, "src_ord")
    return rows.drop("block_start", "row_pos")


def _require_export_fields(raw: DataFrame) -> DataFrame:
    valid = (
        F.col("id").isNotNull()
        & F.col("content").isNotNull()
        & F.col("memory_type").isin(*MEMORY_TYPES)
    )
    refused = F.raise_error(
        F.concat(F.lit("not a memory record: id "), F.coalesce("id", F.lit("missing")))
    )
    # A filter, so that no selection of columns can do without it.
    return raw.where(F.when(F.coalesce(valid, F.lit(False)), F.lit(True)).otherwise(refused.cast("boolean")))


def parse_tags(raw: Column) -> Column:
    """Tags from the text of a JSON array of strings; anything else gives no tags."""
    members = F.try_variant_get(strict_json(raw), "$", "array<variant>")
    strings = F.forall(members, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    return F.coalesce(
        F.when(strings, F.transform(members, lambda x: x.try_cast("string"))), F.array().cast(STRINGS)
    )


@dataclass(frozen=True)
class SnapshotQuery:
    """What to take from a snapshot."""

    agent_id: str | None = None
    any_tags: tuple[str, ...] = ()
    limit: int | None = None


def live_rows(table: DataFrame, agent_id: str | None = None) -> DataFrame:
    """Rows that are not soft-deleted, optionally of one agent. Both tests push down."""
    live = table.where(F.col("deleted_at").isNull())
    return live.where(F.col("agent_id") == agent_id) if agent_id is not None else live


def normalise_snapshot(rows: DataFrame) -> DataFrame:
    """Snapshot rows as memories, unknown types dropped. Keeps ``salience_raw``."""
    kind = F.lower("memory_type")
    return rows.where(kind.isin(*MEMORY_TYPES)).select(
        "id",
        "content",
        kind.alias("memory_type"),
        parse_tags(F.coalesce("tags", F.lit("[]"))).alias("tags"),
        "agent_id",
        F.coalesce("salience", F.lit(DEFAULT_SALIENCE)).cast("float").alias("salience"),
        F.col("salience").alias("salience_raw"),
        *[c for c in rows.columns if c not in {*MEMORY_COLUMNS, "deleted_at", "salience"}],
    )


def unknown_type_count(table: DataFrame) -> DataFrame:
    """Live rows a snapshot read leaves out because their type is unknown."""
    return live_rows(table).agg(
        F.count_if(~F.coalesce(F.lower("memory_type").isin(*MEMORY_TYPES), F.lit(False))).alias(
            "unknown_type"
        )
    )


def match_any_tag(rows: DataFrame, any_tags: tuple[str, ...]) -> DataFrame:
    """Rows that carry at least one of the tags, in any letter case."""
    if not any_tags:
        return rows
    wanted = [x.lower() for x in any_tags]
    return rows.where(F.exists("tags", lambda g: F.lower(g).isin(*wanted)))


def salience_order() -> list[Column]:
    """Highest stored salience first, missing values last, ties by id."""
    return [F.col("salience_raw").desc_nulls_last(), F.col("id").asc()]


#: Rows that agree in salience and id are told apart by these.
TIES = ("content", "memory_type", "agent_id", "tags")


def snapshot_rows(table: DataFrame, query: SnapshotQuery = SnapshotQuery()) -> DataFrame:
    """Live, typed, tag-matching memories without a place; with a limit the most salient ones."""
    rows = match_any_tag(
        normalise_snapshot(live_rows(table, query.agent_id)), query.any_tags
    )
    if query.limit is None:
        return rows
    return rows.orderBy(*salience_order()).limit(query.limit)


def read_snapshot(table: DataFrame, query: SnapshotQuery = SnapshotQuery()) -> DataFrame:
    """Live, typed, tag-matching memories; with a limit the most salient ones.

    Rows are written once in source order, highest salience first, with their dense
    place ``src_ord``; they keep ``salience_raw``.
    """
    rows = snapshot_rows(table, query)
    rows = rows.drop("src_ord")
    return ranked(rows, salience_order(), [F.col(c) for c in TIES], "src_ord")


def qualify_ids(rows: DataFrame, stem: str | Column) -> DataFrame:
    """Prefix ids with the store they come from."""
    prefix = F.lit(stem) if isinstance(stem, str) else stem
    return rows.withColumn("id", F.concat(prefix, F.lit(":"), F.col("id")))


def read_snapshot_parquet(
    spark: SparkSession, path: str, query: SnapshotQuery = SnapshotQuery()
) -> DataFrame:
    """One store kept as Parquet; ids are prefixed with its name without extension."""
    stem = re.sub(r"^(.+?)(\.[^.]*)?$", r"\1", path.rstrip("/").rsplit("/", 1)[-1])
    return qualify_ids(read_snapshot(spark.read.parquet(path), query), stem or "db")


def union_snapshots(
    stores: list[tuple[str, DataFrame]],
    agents: list[str],
    any_tags: tuple[str, ...] = (),
    limit: int | None = None,
) -> DataFrame:
    """Concatenate stores, each with its own agent and limit; duplicates stay.

    ``agents`` holds one agent for all stores or one per store. ``store_ix`` keeps
    the order of the stores; ``src_ord`` goes on from one to the next.
    """
    if not stores:
        raise ValueError("at least one store is required")
    if len(agents) not in (1, len(stores)):
        raise ValueError(
            f"give one agent for all stores or one per store ({len(agents)} for {len(stores)})"
        )
    parts = []
    for i, (stem, table) in enumerate(stores):
        query = SnapshotQuery(agents[i] if len(agents) > 1 else agents[0], any_tags, limit)
        part = qualify_ids(snapshot_rows(table, query), stem)
        parts.append(part.withColumn("store_ix", F.lit(i)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    order = [F.col("store_ix"), *salience_order()]
    return ranked(whole.drop("src_ord"), order, [F.col(c) for c in TIES], "src_ord")


def top_per_store(rows: DataFrame, store: str, limit: int) -> DataFrame:
    """The most salient rows of every store, for many stores held in one table.

    Spark turns the rank filter into a per-task limit before the shuffle, so at
    most ``limit`` rows of a store leave each task however large the store is.
    """
    ranked = W.partitionBy(store).orderBy(*salience_order())
    return (
        rows.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def choose_source(
    export: str | None = None, snapshot: str | None = None, sessions: str | None = None
) -> str:
    """The name of the one source that is given; anything else is an error."""
    given = {
        name: value
        for name, value in {
            "export": export,
            "snapshot": snapshot,
            "sessions": sessions,
        }.items()
        if value is not None
    }
    if len(given) != 1:
        raise ValueError("give exactly one of export, snapshot or sessions")
    return next(iter(given))


