"""Session files, their inventory and the optional bundle sidecar."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirloom.config import LICENSE_CLASSES
from heirloom.schemas import STR, TRACE_BUNDLE, U64, row
from heirloom.sources.lines import file_inventory, file_stem, open_files

# Bounds of the session id ranges.
WORKER_SESSION_BASE = 2**62
SPAWN_SESSION_BASE = 2**63
U64_MAX = 2**64 - 1

STAMP = row(session_id=U64, agent_id=STR, model=STR, license_class=STR)


class NoSessionFiles(ValueError):
    """The directory holds no session files; an empty dataset would hide that."""


def session_globs(spark: SparkSession, directory: str) -> list[str]:
    """The globs under ``directory`` that match files. None at all is an error."""
    base = directory.rstrip("/")
    found = []
    for glob in (f"{base}/*.jsonl", f"{base}/archive/*.jsonl"):
        try:
            if not file_inventory(spark, glob).isEmpty():
                found.append(glob)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        raise NoSessionFiles(f"no session files in {directory}")
    return found


def session_id(path: Column) -> Column:
    """The id in a file name: digits with an optional ``session-``; NULL if none."""
    digits = F.regexp_extract(file_stem(path), r"^(?:session-)?\+?([0-9]+)\z", 1)
    wide = F.nullif(digits, F.lit("")).try_cast("decimal(38,0)")
    return F.when(wide <= F.lit(str(U64_MAX)).cast("decimal(38,0)"), wide).cast(U64)


def session_kind(sid: Column) -> Column:
    spawn = F.lit(str(SPAWN_SESSION_BASE)).cast(U64)
    worker = F.lit(str(WORKER_SESSION_BASE)).cast(U64)
    return (
        F.when(sid == 0, "session_zero")
        .when(sid >= spawn, "spawn")
        .when(sid >= worker, "worker")
        .when(sid.isNotNull(), "normal")
    )


def file_verdict(sid: Column) -> Column:
    """Why a whole file is skipped, NULL when it is read."""
    kind = session_kind(sid)
    return F.when(sid.isNull(), "unparsable").when(kind.isin("session_zero", "spawn"), kind)


def session_files(spark: SparkSession, globs: list[str]) -> DataFrame:
    """One row per file with its id and, for skipped files, the reason."""
    return (
        file_inventory(spark, globs)
        .withColumn("session_id", session_id(F.col("file_path")))
        .withColumn("file_verdict", file_verdict(F.col("session_id")))
    )


def session_lines(spark: SparkSession, globs: list[str]) -> DataFrame:
    """Non-blank lines of the files that are read.

    The file test uses only the file name, so skipped files are pruned from the
    scan and their content is never opened.
    """
    columns = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    lines = open_files(spark, "text", globs, *columns, lineSep="\n")
    return (
        lines.where(file_verdict(session_id(F.col("file_path"))).isNull())
        .select(
            "file_path",
            "block",
            F.monotonically_increasing_id().alias("pos"),
            F.regexp_replace("value", r"\r\z", "").alias("line"),
        )
        .withColumn("session_id", session_id(F.col("file_path")))
    )


def parse_bundles(texts: DataFrame, text: str = "value") -> DataFrame:
    """Bundle sidecars as ``node_id, sessions``; malformed or ill-typed ones vanish."""
    schema = T.StructType([*TRACE_BUNDLE.fields, T.StructField("_corrupt", STR)])
    parsed = texts.withColumn(
        "_b",
        F.from_json(
            F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        ),
    )
    sessions = F.coalesce("_b.sessions", F.array().cast(T.ArrayType(STAMP)))
    known = F.forall(
        sessions,
        lambda s: s["session_id"].isNotNull()
        & F.coalesce(s["license_class"].isin(*LICENSE_CLASSES), s["license_class"].isNull()),
    )
    return (
        parsed.where(F.col("_b._corrupt").isNull() & known)
        .withColumn("node_id", F.col("_b.node_id"))
        .withColumn("sessions", sessions)
        .drop("_b", text)
    )


def read_bundle(spark: SparkSession, directory: str) -> DataFrame:
    """The sidecar of a directory as zero or one row, or of each that a glob names; a missing file is absent."""
    try:
        text = spark.read.text(f"{directory.rstrip('/')}/harvest.json", wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], row(value=STR))
    return parse_bundles(text)


def stamps(bundle: DataFrame, *per: str) -> DataFrame:
    """One stamp per session id, the first where the sidecar repeats one; with ``per`` for each of its values."""
    return (
        bundle.select(*per, F.posexplode("sessions").alias("ix", "s"))
        .groupBy(*per, F.col("s.session_id").alias("session_id"))
        .agg(F.min_by("s", "ix").alias("s"))
        .select(
            *per,
            "session_id",
            F.col("s.agent_id").alias("agent_id"),
            F.col("s.model").alias("model"),
            F.col("s.license_class").alias("stamped_class"),
        )
    )


def resolve_node(directory: str, explicit: str | None, bundle_node: str | None) -> str:
    """Explicit setting, else sidecar, else directory name, else ``unknown``."""
    if explicit is not None:
        return explicit
    if bundle_node is not None:
        return bundle_node
    return directory.rstrip("/").rsplit("/", 1)[-1] or "unknown"


def node_column(explicit: Column, bundle_node: Column, directory: Column) -> Column:
    """The same rule for many directories at once."""
    name = F.element_at(F.split(F.regexp_replace(directory, "/+$", ""), "/"), -1)
    return F.coalesce(explicit, bundle_node, F.nullif(name, F.lit("")), F.lit("unknown"))
