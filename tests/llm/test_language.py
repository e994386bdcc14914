import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from heirloom.llm import arrow_text, language

EN = "the cat and the dog are in the house with the other animals that were there ".split()
DE = "der hund und die katze sind mit den anderen tieren in dem haus das dort ist über ".split()


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang, words = rng.choice([("en", EN), ("de", DE)])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40))), lang, "s", 0.5))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, score DOUBLE")


def brute_bits(texts, text, order):
    """Code length of a text after the texts of one language, symbol by symbol."""
    seen = defaultdict(Counter)
    for t in texts:
        data = b"\0" * order + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[data[i - k : i]][data[i]] += 1
    total, data = 0.0, b"\0" * order + text.encode()
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            counts = seen.get(data[i - k : i])
            if not counts:
                continue
            n, d = sum(counts.values()), len(counts)
            if data[i] in counts:
                total -= math.log2(counts[data[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_those_of_the_trees(spark, monkeypatch):
    rows = corpus(random.Random(1), 40)
    texts = ["", "the dog", "über das house", "xyz €€ 77", "the \x00\x00cat", "qqq " * 30]
    for order in (0, 1, 3, 4):
        model = language.fit(frame(spark, rows), language.PpmConfig(order=order))
        want = [[brute_bits([r[1] for r in rows if r[2] == x], t, order) for x in model.languages] for t in texts]
        for piece in (7, 1 << 19):
            monkeypatch.setattr(language, "PIECE", piece)
            np.testing.assert_allclose(model.code_lengths(pa.array(texts)), want, rtol=1e-4, atol=1e-3)


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(2), 300)
    model = language.fit(frame(spark, rows[:150]))
    got = {r.doc_id: r for r in language.predict(frame(spark, rows), model).collect()}
    assert all(got[r[0]].lang_pred == r[2] and 0.5 <= got[r[0]].score <= 1 for r in rows[150:])


def test_nulls_empty_texts_and_tables(spark):
    rows = corpus(random.Random(3), 30)
    odd = [(None, None, None, None, None), (1, "", "en", None, None), (2, "12 34 !", None, None, None), (3, "the cat", "en", "a", 1.0)]
    model = language.fit(frame(spark, rows + odd))
    got = sorted((r.doc_id or -1, r.lang_pred, r.score) for r in language.predict(frame(spark, odd + odd[3:]), model).collect())
    assert [g[1] for g in got] == ["und", "und", "und", "en", "en"] and got[0][2] == 0.0
    assert language.fit(frame(spark, [])) is None
    assert {r.lang_pred for r in language.predict(frame(spark, odd), None).collect()} == {"und"}
    assert language.predict(frame(spark, []), model).collect() == []


def test_spoken_documents_come_back_as_they_were(spark):
    rows = corpus(random.Random(4), 30) + [(99, "!!", "en", "s", 0.1)]
    df = frame(spark, rows)
    kept = language.spoken(df, language.fit(df))
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] != 99}


def test_groups_cover_all_rows():
    for limit in (1, 3, 100):
        offsets = np.array([0, 0, 5, 6, 6, 20, 21])
        got = list(arrow_text.groups(offsets, limit))
        assert got[0][0] == 0 and got[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_many_languages(spark):
    """More than fit a byte; each is known by letters of its own."""
    rng = random.Random(12)
    own = ["".join(chr(0x4E00 + 3 * k + i) for i in range(3)) for k in range(200)]
    rows = [(k * 4 + i, " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(12)), f"l{k:03d}") for k, a in enumerate(own) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    found = language.predict(docs, language.fit(docs)).collect()
    want = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == want[r.doc_id] for r in found) > 0.98 * len(rows)
