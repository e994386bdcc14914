import random

import pytest

from heirloom.llm import mixing


def ledger(spark, rows, **config):
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, size INT, place STRING")
    return mixing.mix_ledger(df.repartition(3), mixing.MixConfig(**config)).collect()


def rows_of(rng, source, n, most):
    return [(rng.randrange(10**9), "w " * rng.randrange(most), source, 7, "x") for _ in range(n)]


def test_targets_and_taken_words(spark):
    rng = random.Random(1)
    rows = rows_of(rng, "b", 400, 40) + rows_of(rng, "a", 50, 40) + rows_of(rng, None, 100, 40)
    got = ledger(spark, rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(r[1].split())
    # a, b, null weigh 3, 1, 2: a is held at twice its size, the rest is shared 1 : 2, null is held too.
    total = 1.5 * sum(sizes.values())
    want = {"a": 2 * sizes["a"], None: 2 * sizes[None]}
    want["b"] = total - want["a"] - want[None]
    assert want["b"] < 2 * sizes["b"]
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    assert len(got) == len(rows)
    again = {tuple(r) for r in ledger(spark, rows[::-1])}
    assert again == {tuple(r) for r in got}


def test_a_larger_budget_takes_a_superset(spark):
    rows = rows_of(random.Random(2), "a", 300, 30)
    taken = [{r.doc_id for r in ledger(spark, rows, budget=b) if r.taken} for b in (0.2, 0.5, 0.9)]
    assert taken[0] <= taken[1] <= taken[2]


def test_nulls_repeats_and_empty_sources(spark):
    rows = [(None, None, None, 1, ""), (1, "", "e", 1, ""), (2, "a b", "s", 1, "")] + [(3, "a b c", "s", 1, "")] * 4
    got = ledger(spark, rows)
    assert len(got) == len(rows)
    assert {(r.source, r["size"]) for r in got} == {(None, 0), ("e", 0), ("s", 2), ("s", 3)}
    repeated = {r.taken for r in got if r.doc_id == 3}
    assert len(repeated) == 1 and all(r.taken == 0 for r in got if not r["size"])
    assert ledger(spark, []) == []


def test_mix_returns_documents_as_they_came(spark):
    rows = rows_of(random.Random(3), "a", 60, 30)
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, size INT, copies STRING")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "text", "source", "size", "copies"]
    want = {r.doc_id: r.copies for r in mixing.mix_ledger(df.drop("size")).collect() if r.copies}
    assert {r.doc_id: r.copies for r in got.collect()} == want
