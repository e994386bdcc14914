"""Each stage on a small table with planted cases, and the whole run."""

import random
from pathlib import Path

import corpus_pipeline
import pytest

from heirloom.session import materialize, scratch_path

ONLY = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, copies STRING"


def words(rng, n):
    return " ".join(rng.choice(["stone", "water", "letter", "evening", "garden", "window"]) + rng.choice("aeiou") for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        text = "\n".join(words(rng, 12).capitalize() + "." for _ in range(4))
        text = text.upper().replace(" ", "## ") if bad else text
        rows.append((i, text, "en", f"s{i % 3}", len(text), None))
        labels.append((i, int(not bad), 0))
    passage = words(rng, 30)
    rows += [
        (500, rows[1][1], "en", "s1", 1, None),
        (501, passage, "en", "s1", 1, None),
        (502, None, None, None, None, None),
        (503, "123 !?", "en", "s1", 1, None),
        rows[2],
    ]
    folder = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(rows, ONLY).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_decide_and_keep_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, tables), f"test-{name}")
        if name != "mixing_sources":
            assert out.columns == docs.columns
        docs = out
        left[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    good = [i for i in range(160) if i % 4]
    assert left["language_id"] == sorted([*range(160), 2, 500, 501])
    assert left["quality_classifier"] == sorted([*good, 2, 500, 501])
    assert left["near_duplicates"] == sorted([*good, 501])
    assert left["decontamination"] == good
    assert set(left["mixing_sources"]) <= set(good) and docs.columns[-1] == "copies"
    whole = corpus_pipeline.run(spark, tables)
    assert sorted(whole.select("doc_id", "copies").collect()) == sorted(docs.select("doc_id", "copies").collect())


def test_an_empty_table_passes(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, tables), "test-empty")
        assert docs.count() == 0
    assert Path(corpus_pipeline.__file__).exists()
