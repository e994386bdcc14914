import itertools
import random

import numpy as np
import pyarrow as pa

from heirloom.llm import quality


def text(rng, good, lines):
    def line():
        words = [rng.choice("stone water letter evening garden".split()) for _ in range(rng.randrange(4, 12))]
        return " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "##$$" for w in words)

    return "\n".join(line() for _ in range(lines))


def corpus(rng, n):
    return [(i, text(rng, i % 3 > 0, rng.randrange(1, 8)), int(i % 3 > 0), "x") for i in range(n)]


def fitted(spark, rows):
    docs = spark.createDataFrame([r[:2] + ("clash",) for r in rows], "doc_id BIGINT, text STRING, label STRING")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id BIGINT, label INT, text STRING")
    return docs, quality.fit(docs, labels)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    doc = np.array([0] * 5 + [1] + [2] * 3)
    odds, keep = rng.normal(size=9), 0.7
    forward, backward = quality._Chains(doc).passes(odds, keep)
    got = 1 / (1 + np.exp(-(forward + backward)))
    for d in (0, 1, 2):
        at = np.flatnonzero(doc == d)
        good, total = np.zeros(len(at)), 0.0
        for ways in itertools.product((0, 1), repeat=len(at)):
            ways = np.array(ways)
            weight = np.exp((ways * odds[at]).sum() + keep * (ways[1:] == ways[:-1]).sum())
            good, total = good + weight * ways, total + weight
        np.testing.assert_allclose(got[at], good / total)


def test_lines_match_a_plain_split(monkeypatch):
    rng = random.Random(2)
    texts = ["", "\n", "a", "a\n", "\nb", "A b\n\nc.\n", None, "é É\n12 #", text(rng, True, 40), "\n\n"]
    raw, offsets = quality.string_parts(pa.array(texts))
    own, size, doc = quality.line_features(raw, offsets)
    want = [(i, line.encode()) for i, t in enumerate(texts) for line in (t or "").split("\n")]
    assert [(d, s) for d, s in zip(doc, size)] == [(i, len(x)) for i, x in want]
    for (i, line), row in zip(want, own):
        alone = quality.line_features(np.frombuffer(line, np.uint8), np.array([0, len(line)]))[0]
        np.testing.assert_allclose(row, alone[0], err_msg=repr((i, line)))
    whole = quality.line_features(*quality.string_parts(pa.array([texts[8]])))
    monkeypatch.setattr(quality, "PIECE", 50)
    parts = quality._lines(*quality.string_parts(pa.array([texts[8]])))
    for a, b in zip(whole, parts):
        np.testing.assert_allclose(a, b)


def test_held_out_accuracy_and_mixed_documents(spark):
    rng = random.Random(3)
    rows = corpus(rng, 240)
    docs, model = fitted(spark, rows[:120])
    new = spark.createDataFrame([r[:2] for r in rows[120:]], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.score for r in quality.score(new, model).collect()}
    assert all((got[r[0]] >= 0.7) == bool(r[2]) for r in rows[120:])
    half = text(rng, True, 20) + "\n" + text(rng, False, 20)
    assert 0.2 < model.scores(pa.array([half]))[0] < 0.7


def test_nulls_repeats_and_nothing_to_learn(spark):
    docs, model = fitted(spark, corpus(random.Random(4), 60))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "\n\n"), (3, "ok " * 5000)], "doc_id BIGINT, text STRING")
    got = [r.score for r in quality.score(odd, model).collect()]
    assert len(got) == 5 and all(0 <= s <= 1 for s in got) and got[1] == got[2] == got[0]
    empty = docs.limit(0)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id BIGINT, label INT")
    assert {r.score for r in quality.score(odd, quality.fit(empty, labels)).collect()} == {0.5}
    assert quality.score(empty, model).collect() == []
    kept = quality.good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < 60
