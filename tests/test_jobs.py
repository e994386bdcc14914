import json

import pytest
from pyspark.sql import functions as F

from heirloom.operators import cost, jobs, loss
from heirloom.sources import jobs as src

BASE = {
    "id": "j1", "provider": "together", "dataset": {"name": "d", "sha256": "abc"},
    "base_model": "b", "output_name": "o", "method": "lora_sft", "hyperparams": {"n_epochs": 5},
    "trainer_agent": "t", "compute": {"kind": "managed"}, "submitted_at": "2026-01-03T00:00:00Z",
}


def test_log_folds_defaults_and_reports_bad_lines(spark, tmp_path):
    path = tmp_path / "jobs.jsonl"
    done = {**BASE, "terminal": {"outcome": "succeeded", "observed_at": "2026-01-04T00:00:00Z"},
            "provider_job_id": "ft-1", "total_price_nanodollars": 4_000_000_000}
    later = {**BASE, "id": "j2", "submitted_at": "2026-02-01T00:00:00Z"}
    partial = {k: v for k, v in BASE.items() if k != "compute"}
    odd = {**BASE, "provider": "elsewhere"}
    lines = [json.dumps(BASE), "{ junk", "", json.dumps(later), json.dumps(done),
             json.dumps(partial), json.dumps(odd)]
    path.write_text("\n".join(lines) + "\n")
    parsed = src.read_job_log(spark, str(path))
    current = jobs.current_jobs(parsed).collect()
    assert [j["id"] for j in current] == ["j2", "j1"]
    assert current[1]["terminal"]["outcome"] == "succeeded"
    h = current[1]["hyperparams"]
    assert (h["n_epochs"], h["learning_rate"], h["lora_r"], h["lora_alpha"], h["batch_size"]) == (
        5, 1e-5, 16, 32, None,
    )
    skipped = {r["line"]: r["reason"] for r in jobs.skipped_snapshots(parsed).collect()}
    assert skipped == {2: "not a JSON job record", 6: "missing field `compute`",
                       7: "unknown `provider`"}
    assert src.read_job_log(spark, str(tmp_path / "none.jsonl")).count() == 0


@pytest.mark.parametrize(
    "raw,phase",
    [("pending", "submitted"), ("queued", "submitted"), ("compressing", "running"),
     ("uploading", "running"), ("cancel_requested", "cancelling"), ("completed", "succeeded"),
     ("user_error", "failed"), ("cancelled", "cancelled"), ("paused", "unknown"), ("", "unknown")],
)
def test_status_words(spark, raw, phase):
    assert spark.range(1).select(jobs.map_status(F.lit(raw)).alias("p")).first()["p"] == phase


def test_polls(spark):
    bodies = [
        ("j", 1, '{"status":"running"}'),
        ("j", 2, '{"status":"user_error","error":{"message":" bad row "}}'),
        ("j", 3, '{"status":"completed","adapter_output_name":"x","total_price":7}'),
        ("k", 1, '{"status":"error"}'),
        ("l", 1, '{"status":"new"}'),
        ("m", 1, "<html>"),
    ]
    df = spark.createDataFrame(bodies, "id STRING, observed_at BIGINT, body STRING")
    first = {r["id"]: r for r in jobs.poll_fold(jobs.parse_polls(df)).collect()}
    assert set(first) == {"j", "k"}
    assert (first["j"]["phase"], first["j"]["error"]) == ("failed", "bad row")
    assert first["k"]["error"] == jobs.FAILURE_TEXT["error"]


def test_prices_and_estimates(spark):
    sizes = [0.0, 0.1, 16.0, 16.5, 69.0, 100.0, 100.1]
    df = spark.createDataFrame([(s, 9) for s in sizes], "params_b DOUBLE, chars BIGINT")
    rows = {r["params_b"]: r for r in cost.estimate(df, epochs=0).collect()}
    assert [rows[s]["usd_per_mtok"] for s in sizes] == [None, 0.48, 0.48, 1.5, 1.5, 2.9, None]
    assert rows[16.0]["dataset_tokens"] == 3 == rows[16.0]["training_tokens"]
    assert rows[0.0]["training_usd"] is None


def test_loss_curve(spark, tmp_path):
    state = {"log_history": [{"loss": 4.0, "epoch": 0.2}, {"loss": 2.0, "epoch": 0.9}, {"epoch": 1.0},
                             {"loss": 3.0, "epoch": 1.5}, {"loss": 1.0}]}
    (tmp_path / "run1.json").write_text(json.dumps(state))
    log = src.read_trainer_state(spark, str(tmp_path / "run1.json"))
    means = {r["epoch"]: (r["mean_loss"], r["n"]) for r in loss.epoch_means(log).collect()}
    assert means == {0: (7 / 3, 3), 1: (3.0, 1)}
    s = loss.loss_summary(log).first()
    assert (s["run_id"], s["steps"], s["first_step_loss"], s["last_step_loss"]) == ("run1", 4, 4.0, 1.0)


def test_steps_of_a_run_lie_in_as_few_state_files_as_hold_them(spark, monkeypatch):
    from heirloom.plans import fixtures as fx
    from heirloom.plans import job_queries

    steps = [(7, 3_000 * i) for i in range(5)] + [(8, i) for i in range(1001)] + [(9, 5_000_000 * i) for i in range(3)]
    log = spark.createDataFrame([(r, i, 1.0, 0.0) for r, i in steps], "run_id BIGINT, ix BIGINT, loss DOUBLE, epoch DOUBLE")
    written, write = [], fx.write_files
    monkeypatch.setattr(fx, "train_log", lambda spark, sf: log)
    monkeypatch.setattr(fx, "write_files", lambda rows, root: (written.append(rows), write(rows, root)))
    got = {r["run_id"]: r["rows_in"] for r in job_queries.read_trainer_state(spark, "").collect()}
    assert got == {"7": 5, "8": 1001, "9": 3}
    assert sorted(r["name"] for r in written[0].collect()) == ["7.json", "8.json", "8.json", "9.json"]
