"""Audits of an append-only fine-tuning job log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirloom.functions import text as t
from heirloom.schemas import JOB, STR
from heirloom.session import evaluated_once

# Upstream status words and the phase each stands for.
STATUS_PHASE = {
    "pending": "submitted",
    "queued": "submitted",
    "running": "running",
    "compressing": "running",
    "uploading": "running",
    "cancel_requested": "cancelling",
    "completed": "succeeded",
    "error": "failed",
    "user_error": "failed",
    "cancelled": "cancelled",
}
# Phases that end a job.
TERMINAL_PHASES = ("succeeded", "failed", "cancelled")
# Hyperparameters a snapshot may leave out.
DEFAULT_HYPERPARAMS = {"n_epochs": 3, "learning_rate": 1e-5, "lora_r": 16, "lora_alpha": 32}
# Reasons given when upstream states none.
FAILURE_TEXT = {
    "user_error": (
        "upstream reported user_error — the request or dataset was rejected; "
        "check the dataset format and the base model before resubmitting"
    ),
    "error": "upstream reported error — the training run itself failed",
}
# Members a job snapshot must have, and the words some of them allow.
REQUIRED = (
    "id",
    "provider",
    "dataset",
    "base_model",
    "output_name",
    "method",
    "hyperparams",
    "trainer_agent",
    "compute",
    "submitted_at",
)
ALLOWED = {
    "provider": ("together", "vast", "local"),
    "method": ("lora_sft",),
    "compute.kind": ("managed", "node"),
    "terminal.outcome": ("succeeded", "failed", "cancelled"),
}


def parse_snapshots(lines: DataFrame, raw: str = "value") -> DataFrame:
    """Decode log lines into ``job`` or, where that fails, ``skip_reason``.

    Blank lines are dropped; all other columns stay.
    """
    schema = T.StructType([*JOB.fields, T.StructField("_corrupt", STR)])
    parsed = lines.where(t.not_blank(F.col(raw))).withColumn(
        "_j",
        F.from_json(
            F.col(raw), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        ),
    )
    j = F.col("_j")
    reason = F.when(j["_corrupt"].isNotNull() | j.isNull(), F.lit("not a JSON job record"))
    for name in REQUIRED:
        reason = reason.when(j[name].isNull(), F.lit(f"missing field `{name}`"))
    reason = reason.when(
        j["dataset"]["name"].isNull() | j["dataset"]["sha256"].isNull(),
        F.lit("missing field in `dataset`"),
    ).when(
        (j["compute"]["kind"] == "node") & j["compute"]["name"].isNull(),
        F.lit("missing field `name` in `compute`"),
    )
    for path, words in ALLOWED.items():
        value = j
        for step in path.split("."):
            value = value[step]
        reason = reason.when(value.isNotNull() & ~value.isin(*words), f"unknown `{path}`")
    h = j["hyperparams"]
    filled = F.struct(
        *[
            F.coalesce(h[n], F.lit(v)).cast(JOB["hyperparams"].dataType[n].dataType).alias(n)
            for n, v in DEFAULT_HYPERPARAMS.items()
        ],
        h["batch_size"].alias("batch_size"),
    )
    job = F.struct(
        *[
            filled.alias(f.name)
            if f.name == "hyperparams"
            else F.coalesce(j[f.name], F.array().cast(f.dataType)).alias(f.name)
            if f.name == "ledger_refs"
            else j[f.name].alias(f.name)
            for f in JOB.fields
        ]
    )
    decoded = (
        parsed.withColumn("skip_reason", reason)
        .withColumn("job", F.when(F.col("skip_reason").isNull(), job))
        .drop("_j", raw)
    )
    return evaluated_once(decoded, "skip_reason", "job")


def skipped_snapshots(parsed: DataFrame) -> DataFrame:
    """Unreadable lines with their number; reported, never fatal."""
    return parsed.where(F.col("skip_reason").isNotNull()).select(
        F.col("line_no").alias("line"), F.col("skip_reason").alias("reason")
    )


def fold(snapshots: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last snapshot of each job.

    The maximum combines per task before the shuffle, so a job with a third of
    all snapshots still sends one row per task.
    """
    return (
        snapshots.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("_last")).select("_last.*")
    )


def current_jobs(parsed: DataFrame, order: str = "line_no") -> DataFrame:
    """Current state of every readable job, newest first."""
    jobs = parsed.where(F.col("job").isNotNull()).select("job.*", F.col(order).alias("seq"))
    return fold(jobs).orderBy(F.col("submitted_at").desc(), "id")


# ------------------------------------------------------------------ phases


def terminal_phase(outcome: Column) -> Column:
    """The phase a record alone proves; ``unknown`` means one has to poll."""
    return F.when(outcome.isin(*TERMINAL_PHASES), outcome).otherwise("unknown")


def is_terminal(phase: Column) -> Column:
    return phase.isin(*TERMINAL_PHASES)


def map_status(raw: Column) -> Column:
    """Upstream word to phase; a word that is not known is never guessed."""
    phase = F
    for word, name in STATUS_PHASE.items():
        phase = phase.when(raw == word, name)
    return phase.otherwise("unknown")


def _not_blank_text(c: Column) -> Column:
    return t.let(t.strip(c), lambda s: F.when(s != "", s))


def upstream_error(poll: Column) -> Column:
    """Upstream's own words in a poll response held as VARIANT."""
    kind = F.schema_of_variant(F.try_variant_get(poll, "$.error", "variant"))
    plain = F.when(kind == "STRING", F.try_variant_get(poll, "$.error", "string"))
    nested = F.when(
        kind.startswith("OBJECT")
        & (
            F.schema_of_variant(F.try_variant_get(poll, "$.error.message", "variant"))
            == "STRING"
        ),
        F.try_variant_get(poll, "$.error.message", "string"),
    )
    message = F.try_variant_get(poll, "$.error_message", "string")
    return F.coalesce(
        _not_blank_text(message),
        F.when(t.not_blank(plain), plain),
        _not_blank_text(nested),
    )


def failure_reason(raw: Column, upstream: Column) -> Column:
    """Upstream's text, else a sentence that keeps the two failures apart."""
    given = _not_blank_text(upstream)
    sentence = F
    for word, text in FAILURE_TEXT.items():
        sentence = sentence.when(raw == word, text)
    return F.coalesce(given, sentence)


def parse_polls(polls: DataFrame, body: str = "body") -> DataFrame:
    """Captured poll responses as phase, artifact, reason and price."""
    v = F.col("_v")
    decoded = (
        polls.withColumn("_v", F.try_parse_json(body))
        .withColumn(
            "upstream_status",
            F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit("")),
        )
        .withColumn("phase", map_status(F.col("upstream_status")))
        .withColumn(
            "artifact",
            F.coalesce(
                F.try_variant_get(v, "$.adapter_output_name", "string"),
                F.try_variant_get(v, "$.model_output_name", "string"),
            ),
        )
        .withColumn("error", failure_reason(F.col("upstream_status"), upstream_error(v)))
        .withColumn(
            "total_price_nanodollars",
            F.try_variant_get(v, "$.total_price", "decimal(20,0)"),
        )
        .withColumn("_sound", v.isNotNull())
        .drop("_v", body)
    )
    made = ("upstream_status", "phase", "artifact", "error", "total_price_nanodollars", "_sound")
    return evaluated_once(decoded, *made).where("_sound").drop("_sound")


def poll_fold(polls: DataFrame, key: str = "id", order: str = "observed_at") -> DataFrame:
    """The first terminal state observed per job; later polls never revise it."""
    return (
        polls.where(is_terminal(F.col("phase")))
        .groupBy(key)
        .agg(F.min_by(F.struct("*"), order).alias("_first"))
        .select("_first.*")
    )


# ------------------------------------------------------------------ audits


def crash_rows(jobs: DataFrame) -> DataFrame:
    """Jobs that may or may not exist upstream: no provider id, no end."""
    return jobs.where(F.col("provider_job_id").isNull() & F.col("terminal").isNull())


FACTS = (
    "provider",
    "dataset",
    "base_model",
    "output_name",
    "method",
    "hyperparams",
    "trainer_agent",
    "compute",
)


def reused_ids(snapshots: DataFrame) -> DataFrame:
    """Ids whose snapshots show two provider ids or two sets of facts.

    Compared by minimum and maximum, which need no set per id and combine before
    the shuffle.
    """
    facts = F.sha2(F.to_json(F.struct(*FACTS)), 256)
    return (
        snapshots.withColumn("_facts", facts)
        .groupBy("id")
        .agg(
            F.coalesce(
                F.min("provider_job_id") != F.max("provider_job_id"), F.lit(False)
            ).alias("two_provider_ids"),
            (F.min("_facts") != F.max("_facts")).alias("two_fact_sets"),
            F.count("*").alias("snapshots"),
        )
        .where(F.col("two_provider_ids") | F.col("two_fact_sets"))
    )


def cancel_requested(jobs: DataFrame) -> DataFrame:
    """Jobs that were asked to stop and have no observed end."""
    return jobs.where(F.col("cancel_requested_at").isNotNull() & F.col("terminal").isNull())


def download_refusal(outcome: Column, provider_job_id: Column) -> Column:
    """Why a job's artifact cannot be fetched, NULL when it can."""
    phase = terminal_phase(outcome)
    return (
        F.when(phase == "unknown", "job is not terminal — poll it first")
        .when(phase != "succeeded", F.concat(F.lit("phase is "), phase))
        .when(
            F.coalesce(provider_job_id, F.lit("")) == "",
            "no provider_job_id — the upstream never confirmed it",
        )
    )
