import random

from brute_simhash import component_ids, fingerprint
from pyspark.sql import functions as F

from heirloom.llm import simhash
from heirloom.session import materialize_counted


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n)]


def near(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, fp STRING, root INT")
    return sorted(
        (tuple(r) for r in simhash.near_duplicates(df.repartition(3), **more).drop("text_hash").collect()),
        key=lambda r: (r[0] is None, r[0] or 0, r[1]),
    )


def test_fingerprints_links_and_components_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "One TWO", "one\vtwo", "one two  three\n", "é Ünïcode ÉÉ x", "a\x85b c d"]
    for _ in range(60):
        base = words(rng, rng.choice([3, 10, 60, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 6])):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice("abcdef")
            texts.append("  ".join(other))
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "one", None, None), (3, "one", None, None)]
    got = near(spark, rows)
    fps = [(r[0], fingerprint(r[1])) for r in rows]
    want = [(d, fp, c) for (d, fp), c in zip(fps, component_ids(fps))]
    got = [(d, fp % 2**64, c) for d, fp, c in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_spark_has_the_same_hash(spark):
    text = "one Two\nthree"
    df = spark.createDataFrame([(1, text)], "doc_id INT, text STRING")
    fp = simhash.fingerprints(df).first().fp
    assert fp == df.select(F.xxhash64(F.lit("one two three"))).first()[0]


def test_long_texts_are_taken_in_pieces(monkeypatch, spark):
    rng = random.Random(6)
    text = " ".join(words(rng, 700)) + "  \n" + "x" * 300 + " " + " ".join(words(rng, 50)) + " "
    import pyarrow as pa

    for piece in (50, 64, 333, 1000, 10**6):
        monkeypatch.setattr(simhash, "PIECE", piece)
        for t in (text, text.strip(), " " * 200 + "a b", "y" * 500, " " * 500):
            assert int(simhash.fingerprint_column(pa.array([t]))[0]) == fingerprint(t), (piece, t[:20])


def test_index_finds_every_link(spark):
    """Many close fingerprints over several blocks and levels of nodes."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(500)}
    for center in (rng.getrandbits(64), 0, 2**64 - 1):
        fps |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(1500)}
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    rng.shuffle(rows)
    signed = [(i, fp - 2**64 if fp >= 2**63 else fp) for i, fp in rows]
    df = spark.createDataFrame(signed, "doc_id INT, fp BIGINT")
    classes, n = materialize_counted(df, "test-classes")
    forest = [(a % 2**64, b % 2**64) for a, b in simhash.links(classes, n).collect()]
    assert all((a ^ b) for a, b in forest) and len(forest) < 12 * len(fps)
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in forest:
        root[find(a)] = find(b)
    want = component_ids(rows)
    least = {}
    for i, fp in rows:
        least[find(fp)] = min(i, least.get(find(fp), i))
    assert [least[find(fp)] for _, fp in rows] == want


def test_gray_neighbours_differ_in_one_bit(spark):
    ranks = [(i ^ (i >> 1),) for i in range(300)]
    got = spark.createDataFrame(ranks, "fp BIGINT").orderBy(simhash.gray_rank(F.col("fp"))).collect()
    assert [r[0] for r in got] == [r[0] for r in ranks]


def test_empty_table(spark):
    assert near(spark, []) == []
