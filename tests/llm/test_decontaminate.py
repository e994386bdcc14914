import hashlib
import random
import re

from heirloom.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        own, hit, ids, marked = words(text), set(), set(), False
        for item_id, item in items:
            w = words(item)
            n = min(13, len(w))
            parts = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            at = [i for i in range(len(own) - n + 1) if n and tuple(own[i : i + n]) in parts]
            for i in at:
                hit |= set(range(i, i + n))
            if at and item_id is not None:
                ids.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id BIGINT, text STRING, item_id STRING, words INT").repartition(3),
        spark.createDataFrame(items, "item_id BIGINT, text STRING"),
    )


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = "a b c d e É ß x1".split()
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 2, 3, 5, 12, 13, 14, 30, 60])) )) for i in range(14)]
    items += [(None, " ".join(say(20))), (50, None), (51, "?! "), (3, " ".join(say(15))), items[4]]
    docs = [(1, None, None, 1), (2, "", "x", 1), (None, items[6][1], None, None)]
    for i in range(3, 60):
        body = say(rng.choice([0, 3, 40, 200]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            passage = words(rng.choice(items)[1] or "")
            lo = rng.randrange(max(1, len(passage)))
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[rng.choice([0, lo]) :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body).upper().replace("É", "É"), "clash", 3))
    docs += [docs[-1], docs[2], (2, "A b", None, None)]
    got = decontaminate.contamination(*frames(spark, docs, items)).drop("text_hash").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items)


def test_clean_keeps_the_rest_as_it_was(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, passage, "i", 1), (2, "short and clean", "i", 1), (None, None, None, None), (1, "another text", "i", 2)]
    df, items = frames(spark, docs, [(7, passage)])
    kept = decontaminate.clean(df, items)
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == set(docs[1:])
    assert decontaminate.clean(df, items.limit(0)).count() == 4
    assert decontaminate.contamination(df.limit(0), items).collect() == []
