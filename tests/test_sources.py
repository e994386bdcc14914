import json

import pytest
from pyspark.sql import functions as F

from heirloom.schemas import MEMORY_SNAPSHOT
from heirloom.sources import memories as src


def test_export_defaults_and_refusals(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps([{"id": "m1", "content": "hello", "memory_type": "procedural"}]))
    row = src.read_memory_export(spark, str(good)).first()
    assert (row["tags"], row["agent_id"], row["salience"]) == ([], None, 0.5)
    for bad in ('[{"id":"m1","content":"x","memory_type":"wat"}]', '[{"content":"x"}]', "[oops"):
        path = tmp_path / "bad.json"
        path.write_text(bad)
        with pytest.raises(Exception):
            src.read_memory_export(spark, str(path)).collect()


def store(spark):
    rows = [
        ("m1", "p", "procedural", 0.9, '["deploy","pi"]', "ada", None),
        ("m2", "s", "Semantic", None, '["Mesh"]', "ada", None),
        ("m3", "o", "procedural", 0.8, '["deploy"]', "bob", None),
        ("m4", "gone", "procedural", 0.9, '["deploy"]', "ada", "2026-01-01"),
        ("m5", "odd", "wat", 0.9, "[]", "ada", None),
        ("m6", "bad tags", "semantic", 0.6, "not json", "ada", None),
        ("m7", "typed", "semantic", 0.6, "[1,2]", None, None),
        ("m8", "object", "semantic", 0.1, '{"a":1}', None, None),
    ]
    return spark.createDataFrame(rows, MEMORY_SNAPSHOT)


def test_snapshot_rules(spark):
    got = {r["id"]: r for r in src.read_snapshot(store(spark)).collect()}
    assert set(got) == {"m1", "m2", "m3", "m6", "m7", "m8"}
    assert got["m6"]["tags"] == [] and got["m8"]["tags"] == []
    assert got["m2"]["memory_type"] == "semantic" and got["m2"]["salience"] == 0.5
    ids = lambda **k: [r["id"] for r in src.read_snapshot(store(spark), src.SnapshotQuery(**k)).collect()]
    assert sorted(ids(agent_id="ada")) == ["m1", "m2", "m6"]
    assert sorted(ids(any_tags=("MESH", "pi"))) == ["m1", "m2"]
    assert ids(limit=2) == ["m1", "m3"]
    assert ids(agent_id="ada", limit=3) == ["m1", "m6", "m2"]
    assert src.unknown_type_count(store(spark)).first()["unknown_type"] == 1


def test_union_and_source_choice(spark):
    both = src.union_snapshots([("a", store(spark)), ("b", store(spark))], ["ada", "bob"], limit=1)
    assert sorted(r["id"] for r in both.collect()) == ["a:m1", "b:m3"]
    with pytest.raises(ValueError):
        src.union_snapshots([("a", store(spark))] * 3, ["ada", "bob"])
    assert src.choose_source(export="x") == "export"
    for given in ({}, {"export": "x", "sessions": "y"}):
        with pytest.raises(ValueError):
            src.choose_source(**given)


def test_tags_are_strings_and_nothing_follows_them(spark):
    texts = ['["a","b"]', '[1,"a"]', '["a"] ["b"]', '["a"]] x', "[]", "a", None, ' ["c"] ', '[["a"]]', '{"a":1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, tags STRING")
    got = [r["t"] for r in df.select("i", src.parse_tags(F.col("tags")).alias("t")).orderBy("i").collect()]
    assert got == [["a", "b"], [], [], [], [], [], [], ["c"], [], []]


def test_an_export_goes_straight_into_conversion(spark, tmp_path):
    from conftest import LONG

    from heirloom.operators import convert

    records = [{"id": f"m{i}", "content": f"Guide {i}\n\n## One\n\n{LONG}", "memory_type": "procedural"} for i in (3, 1, 2)]
    path = tmp_path / "export.json"
    path.write_text(json.dumps(records))
    outcomes = convert.convert(src.read_memory_export(spark, str(path)))
    assert [r["memory_id"] for r in outcomes.orderBy("src_ord").collect()] == ["m3", "m1", "m2"]
    path.write_text('[{"content":"x","memory_type":"nonsense"}]')
    with pytest.raises(Exception, match="not a memory record"):
        src.read_memory_export(spark, str(path)).groupBy("memory_type").count().collect()


def export_files(folder, sizes):
    folder.mkdir()
    for name, n in sizes.items():
        records = [{"id": f"{name}{i}", "content": f"{name} {i} " + "x" * (i % 50), "memory_type": "semantic"} for i in range(n)]
        (folder / f"{name}.json").write_text(json.dumps(records))
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
    return [f"{name}{i}" for name in sorted(sizes) for i in range(sizes[name])]


def test_source_order_of_several_files(spark, tmp_path):
    want = export_files(tmp_path / "in", {"a": 3, "c": 900, "b": 2, "d": 40})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k", "7k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            for read, kind in ((src.read_memory_export, "json"), (src.read_memory_jsonl, "jsonl")):
                rows = read(spark, str(tmp_path / "in" / f"*.{kind}")).collect()
                rows.sort(key=lambda r: r["src_ord"])
                assert [r["src_ord"] for r in rows] == list(range(len(want)))
                assert [r["id"] for r in rows] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_dataset_does_not_depend_on_how_its_source_is_cut(spark, tmp_path):
    from conftest import LONG

    from heirloom.operators import convert
    from heirloom.sinks import dataset

    (tmp_path / "in").mkdir()
    for name, n in (("z", 2), ("y", 60)):
        records = [{"id": f"{name}{i}", "content": f"Guide {i}\n\n## One\n\n{LONG}", "memory_type": "procedural"} for i in range(n)]
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    digests = set()
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            outcomes = convert.convert(src.read_memory_jsonl(spark, str(tmp_path / "in")))
            meta = dataset.write_dataset(str(tmp_path), f"set-{size}", outcomes, convert.examples(outcomes), "export")
            digests.add(meta.first()["sha256"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(digests) == 1


def test_places_of_a_snapshot(spark):
    rows = src.read_snapshot(store(spark).repartition(5))
    got = sorted((r["src_ord"], r["id"]) for r in rows.collect())
    assert got == list(enumerate(["m1", "m3", "m6", "m7", "m8", "m2"]))
    twice = store(spark).unionAll(store(spark)).repartition(3)
    assert sorted(r["src_ord"] for r in src.read_snapshot(twice).collect()) == list(range(12))
    assert src.read_snapshot(store(spark).limit(0)).count() == 0
    from heirloom.operators import convert

    assert convert.convert(rows).count() == 6
    union = src.union_snapshots([("b", store(spark)), ("a", store(spark))], ["ada"])
    assert [r["id"] for r in union.orderBy("src_ord").collect()] == ["b:m1", "b:m6", "b:m2", "a:m1", "a:m6", "a:m2"]


@pytest.mark.parametrize("few", [10, 0])
def test_places_come_from_one_scan(spark, tmp_path, few, monkeypatch):
    """Rows are numbered by what was written, even if the files are cut differently afterwards."""
    from heirloom.sources import lines

    for k, n in enumerate((5, 700, 1)):
        (tmp_path / f"part-{k:05d}.txt").write_text("".join(f"{k}-{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        numbered = lines.placed(lines.read_lines(spark, str(tmp_path)), False, "at", few)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        got = [r["value"] for r in numbered.orderBy("at").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"{k}-{i}" for k, n in enumerate((5, 700, 1)) for i in range(n)]
    assert sorted(r["at"] for r in numbered.collect()) == list(range(706))


def test_part_numbers_order_files_in_their_own_folder_only(spark, tmp_path):
    for folder, part in (("x=a", 7), ("x=b", 0), ("x=b", 3)):
        (tmp_path / folder).mkdir(exist_ok=True)
        record = {"id": f"{folder}-{part}", "content": "c", "memory_type": "procedural"}
        (tmp_path / folder / f"part-{part:05d}-u.txt").write_text(json.dumps([record]))
    got = src.read_memory_export(spark, str(tmp_path)).orderBy("src_ord").collect()
    assert [r["id"] for r in got] == ["x=a-7", "x=b-0", "x=b-3"]


def test_a_folder_is_listed_once_and_its_files_chosen_by_name(spark, tmp_path):
    """A file is not listed in a task of its own; folders inside and other names stay out."""
    from heirloom.sources import lines

    for k in range(40):
        (tmp_path / f"session-{k}.jsonl").write_text("{}\n")
    for folder in ("archive", "x=1", "x=1/y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "session-99.jsonl").write_text("{}\n")
    (tmp_path / "notes.txt").write_text("no\n")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        found = lines.file_inventory(spark, [f"{tmp_path}/*.jsonl", f"file://{tmp_path}//archive/*.jsonl"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    names = sorted("/".join(r["file_path"].split("/")[-2:]) for r in found.collect())
    assert names == sorted([f"{tmp_path.name}/session-{k}.jsonl" for k in range(40)] + ["archive/session-99.jsonl"])
    assert lines.file_inventory(spark, f"{tmp_path}/*.none").isEmpty()
    assert lines.file_inventory(spark, f"{tmp_path}/notes.txt").count() == 1


def test_files_are_the_same_whoever_writes_them(spark, tmp_path):
    from heirloom.plans import fixtures as fx

    rows = [(("archive", None)[k % 2], f"session-{k}.jsonl", p / 2, f"{k} é {p}\r" if p else "") for k in range(9) for p in (2, 0, 1)]
    rows = spark.createDataFrame(rows, "folder STRING, name STRING, pos DOUBLE, value STRING")

    def files(root):
        return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and p.name[0] != "."}

    fx.write_files(rows, str(tmp_path / "tasks"))
    dealt = rows.repartition("folder", "name").sortWithinPartitions("folder", "name", "pos").drop("pos")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(str(tmp_path)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fx._written_and_renamed(dealt, str(tmp_path / "renamed"), path, fs)
    assert files(tmp_path / "tasks") == files(tmp_path / "renamed")
    assert files(tmp_path / "tasks")["session-1.jsonl"] == "\n1 é 1\r\n1 é 2\r\n".encode()
    assert not list((tmp_path / "tasks").rglob(".*")) and len(files(tmp_path / "tasks")) == 9
