"""The registered queries of this subpackage: thin uses of the operators on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirloom.llm import alignment, decontaminate, fingerprints, html, language, licenses, mixing, pieces, quality
from heirloom.llm import repair, simhash, toxicity, warc
from heirloom.llm.sql import ORACLES
from heirloom.session import materialize

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_learn(rows: DataFrame) -> DataFrame:
    """The rows that models may learn from."""
    return rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = mixing.mix_ledger(table(spark, sf_dir, "documents"))
    return ledger.select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(to_learn(docs)))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.score(docs, toxicity.fit(to_learn(docs), to_learn(labels)))
    return found.select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    found = quality.score(docs, quality.fit(to_learn(docs), to_learn(labels)))
    return found.select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))
    return found.select(
        *("doc_id", "n_chars", "edited_sha256"),
        fingerprints.hex_digits(F.col("fp")).alias("fingerprint"),
        fingerprints.hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        *("near_edited", "near_next"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = alignment.load(tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    found = alignment.alignments(table(spark, sf_dir, "documents"), pair)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    hashed = materialize(found.withColumn("groups_sha256", digest).drop("groups"), "alignments")
    counted = alignment.with_pair_counts(hashed)
    return counted.select(
        *("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pieces.load(tokenizer("piece_bpe_32k.model"))
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), words), words)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Query]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
