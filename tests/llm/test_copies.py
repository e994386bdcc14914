import random

import numpy as np
import pyarrow as pa
from brute_simhash import fingerprint

import corpus_pipeline
from heirloom.llm import copies, simhash

VOCABULARY = [a + b for a in "stone water letter evening garden window".split() for b in "abcdefghijklmnop"]


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice("xyz") + str(rng.random())
    return words


def test_components_match_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    line = " ".join(rng.choice(VOCABULARY) for _ in range(12))
    texts = [None, "", " ", "one", "ONE", "one two", "a b c d e"]
    for n in (6, 30, 60, 150, 400) * 5:
        base = [rng.choice(VOCABULARY) for _ in range(n)]
        texts += [" ".join(base), " ".join(base).upper(), line + " " + " ".join(base)]
        texts += [" ".join(edited(rng, base, rng.randrange(1, 2 + n // 20))) for _ in range(8)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    sets, fps = [grams(t) for t in texts], [fingerprint(t) for t in texts]
    least = list(range(len(texts)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    new = 0
    for i in range(len(texts)):
        for j in range(i):
            close = 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and sets[i]
            apart = (fps[i] ^ fps[j]).bit_count() > 2
            new += bool(close and apart)
            if close or not apart:
                a, b = sorted((find(i), find(j)))
                least[b] = a
    assert new > 50  # pairs that fingerprints alone do not link
    want = [find(i) for i in range(len(texts))]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, fp STRING")
    for step in (copies.STEP, 7):
        monkeypatch.setattr(copies, "STEP", step)
        got = sorted(copies.copies(df.repartition(3)).select("doc_id", "component_id").collect())
        assert [r.component_id for r in got] == want


def test_the_stage_drops_edited_copies(spark):
    rng = random.Random(4)
    base = [rng.choice(VOCABULARY) for _ in range(80)]
    short = [rng.choice(VOCABULARY) for _ in range(45)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:40], "changed", *base[41:]]))]
    rows += [(3, " ".join(short)), (4, " ".join([*short[:-1], "changed"])), (5, " ".join(short[:20] + base[:20]))]
    assert all((fingerprint(a[1]) ^ fingerprint(b[1])).bit_count() > 2 for a, b in (rows[:2], rows[2:4]))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3, 5]


def test_sets_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(VOCABULARY) for _ in range(900))
    want = copies.shingle_sets(pa.array([text]))[0].tolist()
    assert len(want) == len(grams(text))
    monkeypatch.setattr(simhash, "PIECE", 333)
    assert copies.shingle_sets(pa.array([text]))[0].tolist() == want


def test_repeated_rows_null_ids_and_hot_shingles(spark, monkeypatch):
    """Many sets share their rarest shingles; cells and parts of a few rows find the same components."""
    rng = random.Random(6)
    base = [rng.choice(VOCABULARY) for _ in range(60)]
    texts = [" ".join(edited(rng, base, 1)) for _ in range(60)] + [" ".join([*base[:30], *edited(rng, base[30:], 12)]) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2 + [(None, texts[5]), (None, "else entirely, that is"), (None, None)]
    sets = [grams(t) for _, t in rows]
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            close = sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))
            if close or (fps[i] ^ fps[j]).bit_count() <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        want.setdefault(g, set()).add(doc_id)
    want = sorted(sorted(map(str, w)) for w in want.values())
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 AS set_id", "2 AS grams", "3 AS llm_id")
    for cell in (copies.CELL, 5):
        monkeypatch.setattr(copies, "CELL", cell)
        monkeypatch.setattr(copies, "SEEN", cell)
        got = {}
        for r in copies.copies(df.repartition(3)).collect():
            got.setdefault((r.component_id, r.text_hash if r.component_id is None else 0), set()).add(r.doc_id)
        assert sorted(sorted(map(str, w)) for w in got.values()) == want
    assert copies.copies(df.limit(0)).count() == 0


def test_what_is_written_stays_below_the_input(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(400))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    sizes = []
    real = copies.materialize

    def measured(table, label):
        out = real(table, label)
        files = spark.read.format("binaryFile").load(out.scratch_path).select("length").collect()
        sizes.append((label, sum(f.length for f in files)))
        return out

    monkeypatch.setattr(copies, "materialize", measured)
    assert copies.copies(df).count() == 300
    assert sum(n for _, n in sizes) < sum(len(t) for _, t in rows)
    assert dict(sizes)["copies-found"] < sum(len(t) for _, t in rows) / 2


def test_a_shared_passage_alone_sends_nobody_on(spark, monkeypatch):
    """Texts of other sizes go no further with a shingle they share, and large sets are not cut again for it."""
    rng = random.Random(8)
    counts = {}
    real = copies.materialize

    def counted(table, label):
        out = real(table, label)
        counts.setdefault(label, []).append(out.count())
        return out

    def pairs(*sizes):
        rows = []
        for _ in range(12):
            line = [f"line{rng.random()}" for _ in range(60)]
            rows += [[f"own{rng.random()}" for _ in range(n - 60)] + line for n in sizes]
        counts.clear()
        df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id BIGINT, text STRING")
        assert [r.component_id for r in copies.copies(df).orderBy("doc_id").collect()] == list(range(len(rows)))

    monkeypatch.setattr(copies, "materialize", counted)
    pairs(400, 900)
    assert counts["copies-met"] == [0]
    pairs(3000, 3000)
    assert counts["copies-met"][0] > 0 and sum(counts["copies-goes"]) == 0


def test_wide_sketches_bound_the_shingles_apart():
    rng = np.random.default_rng(9)
    for n in (300, 1024, 1025, 2049, 5000):
        for new, gone in ((0, 0), (1, 0), (n // 20, n // 9), (n, 0)):
            a = rng.integers(-(2**63), 2**63 - 1, n)
            b = np.concatenate([a[new + gone :], rng.integers(-(2**63), 2**63 - 1, new)])
            x, y = (copies._wide(g) if len(g) > copies.SKETCH else copies._sketch(g) for g in (a, b))
            apart = copies._bits_apart(x, y)
            assert apart <= len(np.setxor1d(a, b))
            assert new < n or n <= copies.SKETCH or 9 * apart > len(a) + len(b)
