import hashlib
import random
import re

import xxhash

from heirloom.llm import fingerprints


def chained(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hashes = [chained(a, b) for a, b in zip(words, words[1:])] or [chained(w) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def report(spark, rows, monkeypatch, block=4):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", block)
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, fp STRING, nx INT").repartition(3)
    return fingerprints.fingerprint_report(df).collect()


def test_fingerprints_edits_and_neighbours(spark, monkeypatch):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice("ab cd é ef gh 日本".split()) for _ in range(n))
    ids = rng.sample(range(-50, 10**6), 60)
    rows = [(i, say(rng.choice([0, 1, 2, 30, 400])), "x", 1) for i in ids] + [(10**7, None, None, None)]
    ordered = sorted(rows)
    got = {r.doc_id: r for r in report(spark, rows, monkeypatch)}
    assert len(got) == len(rows)
    for (i, text, *_), (_, after, *_) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + after[:quarter]
        fp, edited, following = brute(text), brute(changed), brute(after)
        r = got[i]
        assert (r.n_chars, r.fp % 2**64, r.edited_fp % 2**64) == (len(text), fp, edited)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == 1 - (fp ^ edited).bit_count() / 64
        assert r.near_next == 1 - (fp ^ following).bit_count() / 64


def test_lone_repeated_and_null_ids(spark, monkeypatch):
    one = report(spark, [(5, "abcdefgh", None, None)], monkeypatch)
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    rows = [(1, "same text", "a", 1)] * 9 + [(None, "x y z", "a", 1), (None, None, "a", 1)]
    got = report(spark, rows, monkeypatch)
    assert len(got) == 11 and len({r.fp for r in got if r.doc_id == 1}) == 1
    assert report(spark, [], monkeypatch) == []


def test_tables_find_every_pair(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for n in (1, 2, 3, 4):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed + signed[:5], "fp BIGINT")
    for radius in (1, 3):
        got = sorted((r.a, r.b, r.apart) for r in fingerprints.within_radius(df, radius).collect())
        flat = sorted({x for (x,) in signed})
        want = [
            (a, b, n)
            for i, a in enumerate(flat)
            for b in flat[i + 1 :]
            if (n := ((a ^ b) % 2**64).bit_count()) <= radius
        ]
        assert got == sorted(want)
