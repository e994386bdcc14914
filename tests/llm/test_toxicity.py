import random

import numpy as np
import pyarrow as pa

from heirloom.llm import toxicity

PLAIN = [f"{a}{b}" for a in "ba ke li mo nu ra".split() for b in "do fi ga hen jot kul".split()]
RUDE = ["vermin", "dolt", "oaf"]


def corpus(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.choice([5, 40, 150]))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def trained(rows):
    config = toxicity.GruConfig(rounds=2, steps=100)
    return toxicity.train(pa.array([r[1] for r in rows]), np.array([r[2] for r in rows]), config)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    words = [b"ab", b"cde", b"f", b"ghij"]
    net = toxicity.Network({b"ab": 1, b"f": 2}, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = rng.integers(0, 4, (5, toxicity.WIDTH))
    real = np.arange(toxicity.WIDTH) < np.array([24, 3, 1, 10, 24])[:, None]
    y = np.array([1, 0, 1, 0, 0])

    def loss():
        x = net.inputs(words)[0]
        put = [x @ net.p[f"w{w}"] + net.p[f"c{w}"] for w in "fb"]
        out = net.logits(put[0][ids.T], put[1][ids.T], real)
        return np.mean(np.logaddexp(0, out) - y * out)

    grads = net.gradients(words, ids, real, y)
    for name, g in grads.items():
        flat = np.argsort(-np.abs(g).ravel())[:3]
        for at in np.unravel_index(flat, g.shape) and zip(*np.unravel_index(flat, g.shape)):
            old = net.p[name][at]
            net.p[name][at] = old + 1e-3
            up = loss()
            net.p[name][at] = old - 1e-3
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3 * max(1, abs(g[at]) * 50), (name, at)


def test_windows_cover_every_word():
    count = np.array([0, 1, 23, 24, 25, 36, 37, 100])
    text, start, size = toxicity.windows(count)
    base = np.cumsum(count) - count
    for i, n in enumerate(count):
        covered = set()
        for s, z in zip(start[text == i] - base[i], size[text == i]):
            covered |= set(range(s, s + z))
        assert covered == set(range(n)) and (text == i).any()


def test_held_out_accuracy_pieces_and_odd_texts(monkeypatch):
    rows = corpus(random.Random(2), 600)
    model = trained(rows[:450])
    new = rows[450:]
    got = model.scores(pa.array([r[1] for r in new]))
    assert np.mean((got >= 0.3) == np.array([r[2] for r in new])) > 0.95
    long = " ".join([" ".join(r[1] for r in rows if not r[2]), rows[0][1]])
    odd = pa.array([None, "", "...", long, long])
    whole = model.scores(odd)
    assert all(0 <= s <= 1 for s in whole) and whole[3] == whole[4] > 0.3 and whole[0] == whole[1]
    monkeypatch.setattr(toxicity, "PIECE", 2000)
    assert model.scores(odd)[3] >= whole[3] - 1e-5


def test_spark_fit_and_score(spark):
    rows = corpus(random.Random(3), 120)
    docs = spark.createDataFrame([r[:2] + (None,) for r in rows] + [(None, None, 1)], "doc_id BIGINT, text STRING, label INT")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (1, None)], "doc_id BIGINT, label INT")
    model = toxicity.fit(docs, labels, toxicity.GruConfig(rounds=1, steps=5))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 121 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).collect() == []
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
