"""Queries over job logs, polls, loss curves and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heirloom.operators import cost, jobs, loss
from heirloom.plans import fixtures as fx
from heirloom.plans.registry import query
from heirloom.session import scratch_path
from heirloom.sinks.dataset import dataset_lines
from heirloom.sources import jobs as src
from heirloom.sources.lines import placed, read_lines, running_total

SNAPS = """sn AS (SELECT event_id, event_id + 1 AS line_no, concat('j', user_id) AS id,
  user_id % 120 % 50 AS ft, CASE WHEN event_id % 6 <> 0 THEN concat('ft-', user_id % 50) END AS pid,
  concat('base-', user_id % 3) AS base_model,
  CASE WHEN user_id % 20 = 7 AND event_id % 2 = 0 THEN 'other' ELSE 'smith' END AS trainer_agent,
  CASE WHEN event_id % 5 <> 0 THEN 4 ELSE 3 END AS n_epochs,
  CASE WHEN event_id % 7 <> 0 THEN 32 ELSE 16 END AS lora_r,
  1700000000 + user_id * 60 AS submitted,
  CASE WHEN event_type = 'click' THEN 'succeeded' WHEN event_type = 'error' THEN 'failed'
   WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'cancelled' END AS outcome,
  event_id % 9 = 0 AS cancel,
  CASE WHEN event_id % 4 <> 0 THEN CAST(round(value * 1e9) AS HUGEINT) END AS nano,
  event_id % 101 IN (3, 5) AS bad, event_id % 101 = 7 AS blank FROM events),
 good AS (SELECT * FROM sn WHERE NOT bad AND NOT blank),
 jb AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1)"""

STATUS = """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
  WHEN 'click' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'new_state' END"""
PHASE = """CASE WHEN status IN ('pending', 'queued') THEN 'submitted' WHEN status IN ('running',
  'compressing', 'uploading') THEN 'running' WHEN status = 'cancel_requested' THEN 'cancelling'
  WHEN status = 'completed' THEN 'succeeded' WHEN status IN ('error', 'user_error') THEN 'failed'
  WHEN status = 'cancelled' THEN 'cancelled' ELSE 'unknown' END"""
# The sentences, written out.
UE = (
    "upstream reported user_error — the request or dataset was rejected; "
    "check the dataset format and the base model before resubmitting"
)
ER = "upstream reported error — the training run itself failed"
POLLS = f"""po AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS observed_at,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'user_error' ELSE {STATUS} END AS status,
  CASE event_id % 5 WHEN 0 THEN 'plain words' WHEN 1 THEN 'nested words' WHEN 2 THEN 'first' END
  AS given, CASE WHEN event_id % 8 = 0 THEN CAST(round(value * 1e9) AS HUGEINT) END AS price
  FROM events), pp AS (SELECT id, observed_at, status, {PHASE} AS phase, coalesce(given,
  CASE status WHEN 'user_error' THEN '{UE}' WHEN 'error' THEN '{ER}' END) AS error, price FROM po)"""


def _write_log(spark: SparkSession, sf: str) -> str:
    """The job log as ordered text parts."""
    path = scratch_path(spark, "joblog")
    fx.snapshot_lines(spark, sf).orderBy("event_id").select("value").write.text(path)
    return path


@query(
    "src6_read_job_log",
    f"WITH {SNAPS} SELECT count(*) FILTER (NOT bad) AS readable, count(*) FILTER (bad) AS skipped, "
    "sum(CASE WHEN NOT bad THEN n_epochs * 100 + lora_r END)::BIGINT AS defaults_filled "
    "FROM sn WHERE NOT blank",
)
def read_job_log(spark: SparkSession, sf: str) -> DataFrame:
    parsed = src.read_job_log(spark, _write_log(spark, sf))
    h = F.col("job.hyperparams")
    return parsed.agg(
        F.count("job").alias("readable"),
        F.count("skip_reason").alias("skipped"),
        F.sum(h["n_epochs"] * 100 + h["lora_r"]).alias("defaults_filled"),
    )


@query(
    "win4_line_number",
    "SELECT doc_id AS line_no, n FROM (SELECT row_number() OVER (ORDER BY doc_id, i) AS doc_id, "
    "length(l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))",
)
def line_number(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as lines; the number of every physical line is exact."""
    path = scratch_path(spark, "lines")
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    docs.orderBy("doc_id").select("text").write.text(path)
    # Lines are numbered over all ordered parts; those of one file, as in a job log, alike.
    lines = read_lines(spark, path)
    numbered = placed(lines, False, "place")
    return numbered.select(
        (F.col("place") + 1).alias("line_no"), F.length("value").cast("bigint").alias("n")
    )


@query("win3_job_fold", f"WITH {SNAPS} SELECT id, line_no, outcome, n_epochs::BIGINT AS n_epochs FROM jb")
def job_fold(spark: SparkSession, sf: str) -> DataFrame:
    return fx.jobs(spark, sf).select(
        "id",
        F.col("seq").alias("line_no"),
        F.col("terminal.outcome").alias("outcome"),
        F.col("hyperparams.n_epochs").cast("bigint").alias("n_epochs"),
    )


@query(
    "job1_current_jobs",
    f"WITH {SNAPS} SELECT row_number() OVER (ORDER BY submitted DESC, id) AS place, id FROM jb",
)
def current_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered listing; its places are numbered for the comparison."""
    path = scratch_path(spark, "listing")
    jobs.current_jobs(fx.snapshots(spark, sf)).select("id").write.text(path)
    return dataset_lines(spark, path).select(
        (F.col("position") + 1).alias("place"), F.col("line").alias("id")
    )


@query(
    "job2_skipped_snapshots",
    f"WITH {SNAPS} SELECT line_no AS line, CASE WHEN event_id % 101 = 3 "
    "THEN 'not a JSON job record' ELSE 'missing field `provider`' END AS reason FROM sn WHERE bad",
)
def skipped_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.skipped_snapshots(fx.snapshots(spark, sf))


@query(
    "job3_terminal_phase",
    f"WITH {SNAPS} SELECT coalesce(outcome, 'unknown') AS phase, count(*) AS jobs, "
    "coalesce(sum(nano), 0)::VARCHAR AS nano FROM jb GROUP BY 1",
)
def terminal_phase(spark: SparkSession, sf: str) -> DataFrame:
    phase = jobs.terminal_phase(F.col("terminal.outcome"))
    return fx.jobs(spark, sf).groupBy(phase.alias("phase")).agg(
        F.count("*").alias("jobs"),
        F.coalesce(F.sum("total_price_nanodollars"), F.lit(0)).cast("string").alias("nano"),
    )


@query(
    "job4_map_status",
    f"SELECT event_id, {PHASE} AS phase FROM (SELECT event_id, {STATUS} AS status FROM events)",
)
def map_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "events").withColumn("status", fx.event_status())
    return rows.select("event_id", jobs.map_status(F.col("status")).alias("phase"))


@query(
    "job_phase_totals",
    f"""WITH ls AS (SELECT user_id, {STATUS} AS status, value FROM events
   QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
  SELECT {PHASE} AS phase, count(*) AS jobs,
  CAST(sum(CAST(round(value * 1e9) AS HUGEINT)) AS VARCHAR) AS nano FROM ls GROUP BY 1""",
)
def phase_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Fold the events by user, then phase, count and price."""
    log = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("seq"),
        fx.event_status().alias("status"),
        F.round(F.col("value") * 1e9).cast("decimal(20,0)").alias("nano"),
    )
    folded = jobs.fold(log)
    return folded.groupBy(jobs.map_status(F.col("status")).alias("phase")).agg(
        F.count("*").alias("jobs"), F.sum("nano").cast("string").alias("nano")
    )


@query(
    "job5_failure_reason",
    f"WITH {POLLS} SELECT observed_at, status AS upstream_status, error, "
    "CAST(price AS VARCHAR) AS price FROM pp",
)
def failure_reason(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.parse_polls(fx.polls(spark, sf)).select(
        "observed_at",
        "upstream_status",
        "error",
        F.col("total_price_nanodollars").cast("string").alias("price"),
    )


@query(
    "job6_poll_fold",
    f"""WITH {POLLS} SELECT id, observed_at, phase, error FROM pp WHERE phase IN ('succeeded',
  'failed', 'cancelled') QUALIFY row_number() OVER (PARTITION BY id ORDER BY observed_at) = 1""",
)
def poll_fold(spark: SparkSession, sf: str) -> DataFrame:
    parsed = jobs.parse_polls(fx.polls(spark, sf))
    return jobs.poll_fold(parsed).select("id", "observed_at", "phase", "error")


@query("job7_crash_rows", f"WITH {SNAPS} SELECT id FROM jb WHERE pid IS NULL AND outcome IS NULL")
def crash_rows(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.crash_rows(fx.jobs(spark, sf)).select("id")


@query(
    "job8_reused_ids",
    f"""WITH {SNAPS} SELECT id, count(DISTINCT pid) > 1 AS two_provider_ids,
  count(DISTINCT concat(base_model, '|', trainer_agent, '|', n_epochs, '|', lora_r)) > 1
  AS two_fact_sets, count(*) AS snapshots FROM good GROUP BY id
  HAVING two_provider_ids OR two_fact_sets""",
)
def reused_ids(spark: SparkSession, sf: str) -> DataFrame:
    good = fx.snapshots(spark, sf).where(F.col("job").isNotNull()).select("job.*")
    return jobs.reused_ids(good)


@query("job9_cancel_requested", f"WITH {SNAPS} SELECT id FROM jb WHERE cancel AND outcome IS NULL")
def cancel_requested(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.cancel_requested(fx.jobs(spark, sf)).select("id")


@query(
    "job10_downloadable",
    f"""WITH {SNAPS} SELECT line_no, CASE WHEN outcome IS NULL
  THEN 'job is not terminal — poll it first' WHEN outcome <> 'succeeded'
  THEN concat('phase is ', outcome) WHEN pid IS NULL
  THEN 'no provider_job_id — the upstream never confirmed it' END AS refusal FROM good""",
)
def downloadable(spark: SparkSession, sf: str) -> DataFrame:
    good = fx.snapshots(spark, sf).where(F.col("job").isNotNull())
    refusal = jobs.download_refusal(F.col("job.terminal.outcome"), F.col("job.provider_job_id"))
    return good.select("line_no", refusal.alias("refusal"))


@query(
    "agg14_job_cost",
    f"""WITH {SNAPS} SELECT trainer_agent, base_model, count(*) AS jobs,
  round(CAST(sum(nano) AS DOUBLE) / 1e9, 6) AS usd,
  count(*) FILTER (CAST(nano AS DOUBLE) / 1e9 > 2 * ft * 1000000 / 1e6 * 0.48)
  AS minimum_charges FROM jb GROUP BY trainer_agent, base_model""",
)
def job_cost(spark: SparkSession, sf: str) -> DataFrame:
    current = fx.jobs(spark, sf)
    tokens = F.substring_index("dataset.name", "ds", -1).cast("int") % 50 * 1_000_000
    bill = cost.usd(F.col("total_price_nanodollars"))
    minimum = cost.minimum_charge(bill, tokens, F.lit(0.48))
    return cost.job_cost(current, minimum).withColumn("usd", F.round("usd", 6))


# -------------------------------------------------------------------- loss

LOG = """lg AS (SELECT user_id AS run_id, event_id AS ix, CASE WHEN event_id % 50 <> 0 THEN value END
  AS loss, CASE WHEN event_id % 70 <> 0 THEN (event_id % 30) / 10.0 - 0.5 END AS epoch FROM events)"""


@query(
    "src7_read_trainer_state",
    "SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS rows_in, "
    "count(*) FILTER (event_id % 50 <> 0) AS with_loss FROM events GROUP BY user_id",
)
def read_trainer_state(spark: SparkSession, sf: str) -> DataFrame:
    """State files of at most a thousand steps each, named by their run, and read back."""
    # Steps are counted within their run: by event number a file would hold a step or two of it.
    log = fx.train_log(spark, sf).withColumn("block", F.floor(F.col("ix") / (1 << 20)))
    log = running_total(log, ["run_id"], "block", ["ix"], F.lit(1), "step")
    log = log.withColumn("part", F.floor((F.col("step") - 1) / 1000))
    step = F.struct("ix", F.struct("loss", F.col("epoch")).alias("s"))
    states = (
        log.groupBy("run_id", "part")
        .agg(F.sort_array(F.collect_list(step)).alias("h"))
        .select(
            F.col("part").cast("string").alias("folder"),
            F.concat(F.col("run_id").cast("string"), F.lit(".json")).alias("name"),
            F.lit(0).alias("pos"),
            F.to_json(F.struct(F.transform("h", lambda x: x["s"]).alias("log_history"))).alias(
                "value"
            ),
        )
    )
    root = scratch_path(spark, "states")
    fx.write_files(states, root)
    return src.read_trainer_state(spark, f"{root}/*/*.json").groupBy("run_id").agg(
        F.count("*").alias("rows_in"), F.count("loss").alias("with_loss")
    )


@query(
    "agg7_epoch_means",
    f"""WITH {LOG} SELECT run_id, CAST(greatest(floor(coalesce(epoch, 0)), 0) AS BIGINT) AS epoch,
  CAST(round(sum(loss) * 100) AS BIGINT) AS mean_times_n_cents, count(*) AS n FROM lg
  WHERE loss IS NOT NULL GROUP BY 1, 2""",
)
def epoch_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means, compared as whole cents: a rounded mean would depend on summation order."""
    return loss.epoch_means(fx.train_log(spark, sf)).select(
        "run_id",
        F.col("epoch").cast("bigint").alias("epoch"),
        F.round(F.col("mean_loss") * F.col("n") * 100).cast("bigint").alias("mean_times_n_cents"),
        "n",
    )


@query(
    "agg8_loss_summary",
    f"""WITH {LOG} SELECT run_id, count(*) AS steps, arg_min(loss, ix) AS first_step_loss,
  arg_max(loss, ix) AS last_step_loss FROM lg WHERE loss IS NOT NULL GROUP BY run_id""",
)
def loss_summary(spark: SparkSession, sf: str) -> DataFrame:
    return loss.loss_summary(fx.train_log(spark, sf))
