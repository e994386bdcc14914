import pytest
from conftest import LONG, memory
from pyspark.sql import functions as F

from heirloom.operators import lineage, registry
from heirloom.schemas import MODEL
from heirloom.sinks import dataset as ds


@pytest.fixture
def models(spark):
    def make(*edges):
        rows = [(n, "base", None, None, "t", None, p, None, None) for n, p in edges]
        return spark.createDataFrame(rows, MODEL)

    return make


def walk(df, start):
    rows = df.where(F.col("start") == start).orderBy("generation").collect()
    return [r["model"] for r in rows]


EDGES = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "z"), ("z", "y"),
         ("lost", "gone"), ("self", "self")]


def test_all_walks_and_their_ends(models):
    m = models(*EDGES)
    got = lineage.ancestry(m)
    assert walk(got, "d") == ["d", "c", "b", "a"]
    assert walk(got, "x") == ["x", "y", "z"]
    assert walk(got, "self") == ["self"]
    ends = {r["start"]: r["reason"] for r in lineage.incomplete(lineage.chain_ends(m), m).collect()}
    assert ends["d"] is None
    assert ends["lost"] == 'parent "gone" of "lost" is not in the registry'
    assert ends["x"].startswith('parent cycle detected at "y"')
    assert ends["self"].startswith('parent cycle detected at "self"')


def test_one_walk_agrees_and_unknown_names_are_refused(models):
    m = models(*EDGES)
    everyone = lineage.ancestry(m)
    for start in ("d", "x", "lost"):
        assert walk(lineage.walk_from(m, start), start) == walk(everyone, start)
    with pytest.raises(lineage.UnknownModel):
        lineage.walk_from(m, "nobody")


def test_long_chain(models):
    chain = [(f"m{i}", f"m{i - 1}" if i else None) for i in range(150)]
    got = lineage.ancestry(models(*chain))
    assert walk(got, "m149") == [f"m{i}" for i in range(149, -1, -1)]
    assert got.count() == 150 * 151 // 2


def test_ends_agree_with_walks(models):
    m = models(*EDGES)
    ends = {r["start"]: (r["last_generation"], r["last_model"]) for r in lineage.chain_ends(m).collect()}
    everyone = lineage.ancestry(m)
    for start, (generation, last) in ends.items():
        seen = walk(everyone, start)
        assert (len(seen) - 1, seen[-1]) == (generation, last)
    assert set(ends) == {n for n, _ in EDGES}


def plain_walk(parents, start):
    seen, at = [], start
    while at in parents and at not in seen:
        seen.append(at)
        at = parents[at]
    return seen


def random_edges(rng, n):
    """Trees, chains and cycles of several lengths, with missing parents."""
    names = [f"m{i}" for i in range(n)]
    edges = {x: rng.choice([*names[max(0, i - 4) : i], *names[:i][:3], None, "gone"]) for i, x in enumerate(names)}
    for at in (n // 5, n // 2):
        for length in (1, 2, 5):
            ring = names[at : at + length]
            edges.update({x: ring[(k + 1) % length] for k, x in enumerate(ring)})
            at += length
    return edges


def test_forest_labels_walks_and_ends(models):
    import random

    for seed in range(2):
        edges = random_edges(random.Random(seed), 120)
        m = models(*edges.items())
        trees = lineage.forest(m)
        labels = {r["node"]: r for r in lineage.labelled(trees).collect()}
        assert sorted(r["pre"] for r in labels.values()) == list(range(len(edges)))
        cut = {r["node"]: r["to"] for r in labels.values()}
        for x, r in labels.items():
            above = plain_walk(cut, x)
            assert (above[-1], len(above) - 1) == (r["root"], r["depth"])
            for y, q in labels.items():
                assert (q["pre"] <= r["pre"] < q["pre"] + q["size"]) == (y in above)
        got = {}
        for r in lineage.ancestry(m, trees=trees).collect():
            got.setdefault(r["start"], {})[r["generation"]] = r["model"]
        want = {x: dict(enumerate(plain_walk(edges, x))) for x in edges}
        assert got == want
        ends = {r["start"]: (r["last_generation"], r["last_model"]) for r in lineage.chain_ends(m, trees).collect()}
        assert ends == {x: (len(w) - 1, w[len(w) - 1]) for x, w in want.items()}
        some = models().select(F.lit("m7").alias("start"))
        assert lineage.ancestry(m, some, trees).count() == 0


def test_reach_counts_agree_with_pairs(spark):
    import random

    rng = random.Random(7)
    edges = random_edges(rng, 90)
    used = {x: rng.choice([None, "d1", "d2", "d3", "d4", "unused"]) for x in edges}
    rows = [(n, "base", (used[n], "h", "p") if used[n] else None, None, "t", None, p, None, None) for n, p in edges.items()]
    width = len(MODEL["dataset"].dataType.fields)
    rows = [(*r[:2], (*r[2], *[None] * 9)[:width] if r[2] else None, *r[3:]) for r in rows]
    m = spark.createDataFrame(rows, MODEL)
    held = [("d1", "a", 2), ("d1", "b", 1), ("d2", "b", 5), ("d2", "c", 1), ("d3", "a", 1), ("d3", "e", 4), ("d5", "z", 1)]
    memories = spark.createDataFrame(held, "dataset STRING, memory_id STRING, examples BIGINT")
    models_of, want = {}, {}
    for x in edges:
        walk_of = plain_walk(edges, x)
        sets = {used[y] for y in walk_of} - {None}
        fed = [h for h in held if h[0] in sets]
        if fed:
            near = min(k for k, y in enumerate(walk_of) if used[y] in {h[0] for h in held})
            want[x] = (len({h[1] for h in fed}), sum(h[2] for h in fed), near)
        for memory_id in {h[1] for h in fed}:
            own = any(h[0] == used[x] and h[1] == memory_id for h in held)
            models_of.setdefault(memory_id, []).append(own)
    got = {r["start"]: (r["memories"], r["examples"], r["nearest"]) for r in lineage.model_reach(m, memories).collect()}
    assert got == want
    hit = {r["memory_id"]: (r["models"], r["direct"]) for r in lineage.memory_reach(m, memories).collect()}
    assert hit == {k: (len(v), sum(v)) for k, v in models_of.items()}


def test_a_chain_of_many_models_takes_one_row_each(models):
    chain = [(f"m{i:05d}", f"m{i - 1:05d}" if i else None) for i in range(5000)]
    m = models(*chain)
    trees = lineage.forest(m)
    assert len(trees.jumps) == 13
    last = lineage.chain_ends(m, trees).where("start = 'm04999'").first()
    assert (last["last_generation"], last["last_model"]) == (4999, "m00000")
    label = lineage.labelled(trees).where("node = 'm04000'").first()
    assert (label["pre"], label["size"], label["depth"]) == (4000, 1000, 4000)


def test_register_attach_and_build(spark, memories, tmp_path):
    root = str(tmp_path / "reg")
    rows = memories(memory("m", f"Guide\n\n## One\n\n{LONG}"))
    registry.create_apprentice(spark, root, "app", "ada", "App", "exports", "base", "set", rows)
    with pytest.raises(registry.AlreadyExists):
        registry.create_apprentice(spark, root, "app", "ada", "App", "exports", "base", "s2", rows)
    with pytest.raises(ds.NoExamples):
        registry.create_apprentice(
            spark, root, "b", "ada", "B", "x", "base", "s3", memories(memory("m", "x"))
        )
    made = registry.apprentices(spark, root).first()
    sha = ds.read_meta(spark, f"{root}/datasets", "set").first()["sha256"]
    assert made["dataset"]["sha256"] == sha and made["model"] is None

    with pytest.raises(LookupError):
        registry.register_model(spark, root, "v1", "base", "t", dataset_name="none")
    registry.register_model(spark, root, "v1", "base", "t", dataset_name="set")
    with pytest.raises(registry.AlreadyExists):
        registry.register_model(spark, root, "v1", "base", "t")
    with pytest.raises(registry.RecordNotFound):
        registry.register_model(spark, root, "v2", "base", "t", parent="nope")
    registry.register_model(spark, root, "v2", "base", "t", parent="v1")
    table = spark.read.schema(MODEL).parquet(f"{root}/models")
    assert table.where("name = 'v1'").first()["dataset"]["sha256"] == sha

    with pytest.raises(registry.RecordNotFound):
        registry.attach(spark, root, "app", "model", "v9", table.select("name"))
    after = registry.attach(spark, root, "app", "model", "v2", table.select("name")).first()
    assert after["model"] == "v2" and after["job_id"] is None
    again = registry.attach(spark, root, "app", "model", "v1", table.select("name")).first()
    assert again["model"] == "v1" and again["version"] > after["version"]
    registry.attach(spark, root, "app", "model", "v2", table.select("name"))
    bound = registry.bind_upload(spark, root, "file-1", "set", ds.data_path(f"{root}/datasets", "set")).first()
    assert bound["dataset"]["sha256"] == bound["projected_sha256"] == sha
    lit = F.lit
    event = registry.lineage_event(lit("trained"), F.col("name"), lit("set"), lit(sha), lit("t"), lit("a"), lit("ok"))
    registry.append_events(table.select(event.alias("event")), root)
    assert spark.read.parquet(f"{root}/events").count() == table.count()
    meta = ds.list_datasets(spark, f"{root}/datasets")
    steps = registry.resolve_lineage(table, meta, registry.apprentices(spark, root), "app")
    flags = {r["model"]: (r["dataset_examples"], r["dataset_missing"]) for r in steps.collect()}
    assert flags == {"v2": (None, False), "v1": (1, False)}


def test_event_names_the_hash_only_when_both_are_known(spark):
    df = spark.createDataFrame([("d", None), ("d", "h"), (None, None)], "d STRING, h STRING")
    lit = F.lit
    e = registry.lineage_event(
        lit("trained"), lit("m"), F.col("d"), F.col("h"), lit("t"), lit("a"), lit("ok")
    )
    rows = [r["e"] for r in df.select(e.alias("e")).collect()]
    assert rows[0]["content"] == "[nursery:trained] m — ok\ntrainer_agent: t"
    assert rows[1]["content"].endswith("\ndataset: d (h)")
    assert rows[1]["tags"] == ["nursery", "nursery:trained", "model:m", "dataset:d"]
    assert rows[2]["tags"] == ["nursery", "nursery:trained", "model:m"]


def test_a_batch_is_judged_one_by_one(spark, models):
    rows = [
        (1, "m1", "lost", None), (2, "m1", None, None), (3, "m1", None, None), (4, "m2", None, "m1"),
        (5, "m3", None, "m2"), (0, "early", None, "m1"), (6, "m4", None, "nobody"), (7, "a", None, None),
        (8, "x/y", None, None), (9, "early", None, "m3"),
    ]
    batch = spark.createDataFrame(rows, "ord INT, name STRING, dataset_name STRING, parent STRING")
    meta = spark.createDataFrame([("known", "sha")], "name STRING, sha256 STRING")
    got = registry.check_registrations(batch, models(("a", None)), meta, "ord").collect()
    assert {r["ord"]: r["refusal"] for r in got} == {
        0: "parent_missing", 1: "dataset_missing", 2: None, 3: "already_exists", 4: None, 5: None,
        6: "parent_missing", 7: "already_exists", 8: "invalid_name", 9: None,
    }


def test_tables_of_models_are_not_sent_to_all_tasks(spark, monkeypatch):
    """Whatever the size of their files; a ring and a tree, so that all steps are taken."""
    import re

    from heirloom.operators import lineage

    names = [("a", "b", "d1"), ("b", "a", None), ("c", "b", "d2"), ("r", None, "d1"), ("s", "r", None), ("t", "s", "d2")]
    models = spark.createDataFrame(
        [(n, p, d and {"name": d}) for n, p, d in names], "name STRING, parent STRING, dataset STRUCT<name: STRING>"
    )
    used = spark.createDataFrame([("d1", "m1", 2), ("d2", "m1", 1), ("d2", "m2", 1)], "dataset STRING, memory_id STRING, examples BIGINT")
    plans = []

    def recorded(write):
        return lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, label))[1]

    for step in ("materialize", "materialize_counted"):
        monkeypatch.setattr(lineage, step, recorded(getattr(lineage, step)))
    reach = lineage.model_reach(models, used)
    plans.append(reach._jdf.queryExecution().executedPlan().toString())
    got = {r["start"]: (r["memories"], r["examples"], r["nearest"]) for r in reach.collect()}
    assert got == {
        "a": (1, 2, 0), "b": (1, 2, 1), "c": (2, 4, 0), "r": (1, 2, 0), "s": (1, 2, 1), "t": (2, 4, 0),
    }
    sent = [k for plan in plans for k in re.findall(r"BroadcastHashJoin \[(\w+)#", plan)]
    assert not set(sent) & {"node", "jump", "name", "parent", "to", "start", "pre", "root"}
