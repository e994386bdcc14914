"""Ordered lines of text files, read in splits.

Order is needed for line numbers, for "the last snapshot wins" and for rounds of
a session. Reading a file whole would give it, but puts a file into one row and
one task. Here a large file is read in splits as usual; the order comes from the
split offset and the position inside the split, and exact line numbers from
adding up the line counts of earlier splits.

Two scans of a file may cut it differently (the number of cores decides with), so
counts of one scan don't hold for the rows of another: what is numbered is written
once, and both counts and rows are read from there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heirloom.session import materialize, materialize_counted

BLOCK = ["file_path", "block_start"]
#: The folders of an export are named by this and by the split that each holds.
SPLIT = "split"


def read_lines(spark: SparkSession, paths: str | list[str], exact: bool = False) -> DataFrame:
    """Lines as ``file_path, block_start, row_pos, value, file_size``, split at ``\\n`` only.

    ``(block_start, row_pos)`` orders the lines of a file. ``row_pos`` grows by one from
    line to line of a split, from an arbitrary number on. ``exact`` keeps the bytes as
    they are stored; parsers do without a ``\\r`` at the end.
    """
    value = F.col("value") if exact else F.regexp_replace("value", r"\r\z", "")
    return (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("row_pos"),
            value.alias("value"),
            F.col("_metadata.file_size").alias("file_size"),
        )
    )


def running_total(
    df: DataFrame,
    group: list[str],
    block: str,
    order: list[str],
    amount: Column,
    out: str,
    skip_first: bool = False,
) -> DataFrame:
    """Add the inclusive running sum of ``amount`` along ``group`` as ``out``.

    ``skip_first`` leaves the amount of the first row of a group out of the sum.

    Rows are ordered by ``block`` and, inside a block, by ``order``. A plain
    window would put a whole group into one task. Here a task sees one block of a
    group, and only one subtotal per block is summed along the group.
    """
    keys = [*group, block]
    staged = df.withColumn("_amount", amount.cast("bigint"))
    sums = [F.sum("_amount").alias("_block_sum")]
    if skip_first:
        sums.append(F.min_by("_amount", F.struct(*order)).alias("_block_first"))
    subtotals = staged.groupBy(*keys).agg(*sums)
    along = W.partitionBy(*group).orderBy(block)
    before = F.sum("_block_sum").over(along.rowsBetween(W.unboundedPreceding, -1))
    offset = F.coalesce(before, F.lit(0))
    if skip_first:
        opening = along.rowsBetween(W.unboundedPreceding, 0)
        offset = offset - F.first("_block_first").over(opening)
    offsets = subtotals.select(*keys, offset.alias("_offset"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = staged.withColumn("_inside", F.sum("_amount").over(inside))
    matched = running.alias("l").join(
        offsets.alias("r"),
        [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys],
        "inner",
    )
    return matched.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("_inside") + F.col("_offset")).alias(out),
    )


#: Up to so many splits their offsets (16 bytes each) are sent to all tasks.
FEW_SPLITS = 1 << 21


def part_number(path: Column) -> Column:
    """The number of a part file; names that have none come first."""
    number = F.regexp_extract(path, r"part-(\d{1,18})[^/]*$", 1)
    return F.when(number != "", number.cast("bigint")).otherwise(F.lit(-1).cast("bigint"))


def placed(rows: DataFrame, per_file: bool, out: str, few: int = FEW_SPLITS) -> DataFrame:
    """Write the rows of one scan and add the dense 0-based place of each, in its file or over all
    ordered parts.

    ``rows`` have ``file_path, block_start, row_pos`` and what else is needed of them. Only one
    count per split is added up. A row's place is its distance from the first of its split plus
    the rows of the splits before. So that no row moves, splits are known by a hash of eight
    bytes while no two share it.
    """
    split = F.xxhash64(*BLOCK)
    rows = materialize(rows, "placed-rows")
    counts = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("_n"), F.min("row_pos").alias("_low"))
    if per_file:
        along = W.partitionBy("file_path").orderBy("block_start")
    else:
        # The number of a part file tells its place in its own folder only.
        folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
        along = W.orderBy(folder, part_number(F.col("file_path")), "file_path", "block_start")
    before = F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1))
    offset = (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_offset")
    offsets, count = materialize_counted(counts.select(*BLOCK, split.alias("_split"), offset), "placed-splits")
    hashed = count <= few and offsets.select("_split").distinct().count() == count
    if hashed:
        small = F.broadcast(offsets.select("_split", "_offset"))
        joined = rows.withColumn("_split", split).join(small, "_split").drop("_split")
    else:
        joined = rows.join(offsets.drop("_split"), BLOCK)
    return joined.withColumn(out, F.col("row_pos") + F.col("_offset")).drop("_offset")


def ranked(rows: DataFrame, order: list[Column], ties: list[Column], out: str) -> DataFrame:
    """Write the rows in order and add the dense 0-based place of each.

    Rows are dealt by ranges of ``order`` and sorted there, rows that are equal in it by ``ties``
    as well, and written once: ranges are found by sampling and need not be the same again.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, *ties)
    held = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked-rows")
    # The number grows along the ranges, with gaps from one to the next.
    part = F.shiftright("_at", 33).alias("_part")
    counts = held.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_offset"))
    # A row for each task of one stage.
    joined = held.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add the 1-based physical line number; blank lines count."""
    return placed(lines, True, "line_no").withColumn("line_no", F.col("line_no") + 1)


def open_files(spark: SparkSession, source: str, paths: str | list[str], *columns: Column, **options) -> DataFrame:
    """``columns`` of the files that ``paths`` name; each may end in a pattern of file names.

    Spark takes each file that a pattern matches for a path of its own and lists it in a task of
    its own. Here the folder is listed, and its files are chosen by name. A folder without a
    match has no rows, a missing one is an error.
    """
    parts = []
    for path in [paths] if isinstance(paths, str) else paths:
        reader = spark.read.format(source).options(**options)
        folder, _, name = path.rpartition("/")
        if not folder or not set(name) & set("*?[{"):
            parts.append(reader.load(path).select(*columns))
            continue
        found = reader.options(pathGlobFilter=name, recursiveFileLookup=True).load(folder)
        # Files of folders inside are not matched by the pattern. Only names are tested, so nothing of them is opened.
        local = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        local = local.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(local)
        depth = len(local.toUri().getPath().rstrip("/").split("/"))
        below = F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
        parts.append(found.where(F.size(F.split(below, "/")) == depth + 1).select(*columns))
    return reduce(DataFrame.unionAll, parts)


def file_inventory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file, from the listing alone: no content is read."""
    return open_files(
        spark, "binaryFile", paths, F.col("path").alias("file_path"), F.col("length").alias("file_bytes")
    )


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"^(.+?)(?:\.[^.]*)?$", 1)
