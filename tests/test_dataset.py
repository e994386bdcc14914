import json

import pytest
from conftest import LONG, memory
from pyspark.sql import functions as F

from heirloom.operators import convert
from heirloom.session import materialize
from heirloom.sinks import dataset as ds
from heirloom.sinks import export


def many(n=30):
    return [memory(f"m{i}", f"Guide {i}\n\n## One\n\n{LONG}\n\n## Two\n\n{LONG} {i}") for i in range(n)]


def write(root, name, rows):
    outcomes = materialize(convert.convert(rows), "t")
    return ds.write_dataset(root, name, outcomes, convert.examples(outcomes), "export_file").first()


def test_identity_ignores_partitioning_and_notices_content(memories, tmp_path):
    root = str(tmp_path / "sets")
    a = write(root, "a", memories(*many(), partitions=1))
    b = write(root, "b", memories(*many(), partitions=7))
    c = write(root, "c", memories(*many()[::-1]))
    assert a["sha256"] == b["sha256"] != c["sha256"]
    assert a["example_count"] == 60 and a["memories_used"] == 30


def test_existing_and_empty_datasets_are_refused(memories, tmp_path):
    root = str(tmp_path / "sets")
    write(root, "a", memories(*many(2)))
    with pytest.raises(ds.DatasetExists):
        write(root, "a", memories(*many(2)))
    with pytest.raises(ds.NoExamples, match="1 inputs rejected"):
        write(root, "none", memories(memory("x", "tiny")))
    for bad in ("", "../a", ".a", "a/b", "a\\b", "a\nb"):
        with pytest.raises(ValueError):
            ds.check_name(bad)


def test_sidecar_counts_and_listing(spark, memories, tmp_path):
    root = str(tmp_path / "sets")
    meta = write(root, "a", memories(*many(3), memory("x", "tiny"), memory("y", LONG, "episodic")))
    assert meta["rejections"] == {"too_short": 1, "type_excluded": 1}
    assert meta["memories_used"] + meta["rejected_total"] == meta["source"]["memories_in"] == 5
    assert meta["framing"] == {"templated_heading": 6}
    assert [r["name"] for r in ds.list_datasets(spark, root).collect()] == ["a"]
    assert ds.list_datasets(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(LookupError):
        ds.read_meta(spark, root, "zzz")


def test_old_sidecar_still_loads(spark, tmp_path):
    old = {"name": "o", "sha256": "x", "example_count": 1, "memories_used": 1, "rejections": {},
           "rejected_total": 0, "source": {"kind": "export_file", "memories_in": 1},
           "tool_version": "0", "created_at": "2026-01-01T00:00:00Z"}
    (tmp_path / "o.meta.json").write_text(json.dumps(old))
    meta = ds.read_meta(spark, str(tmp_path), "o").first()
    assert meta["framing"] == {} and meta["unframeable_chunks"] == 0


def test_verify_detects_a_changed_byte(spark, memories, tmp_path):
    root = tmp_path / "sets"
    write(str(root), "a", memories(*many(3)))
    assert ds.verify_dataset(spark, str(root), "a").first()["matches"]
    part = next(p for p in (root / "a.jsonl").glob("part-*") if p.stat().st_size)
    part.write_text(part.read_text().replace("operator", "0perator", 1))
    crc = part.with_name(f".{part.name}.crc")
    crc.unlink(missing_ok=True)
    assert not ds.verify_dataset(spark, str(root), "a").first()["matches"]


def test_export_keeps_messages_only_and_order(spark, memories, tmp_path):
    root = str(tmp_path / "sets")
    write(root, "a", memories(*many(4)))
    out = str(tmp_path / "out")
    export.export_provider(spark, ds.data_path(root, "a"), out)
    lines = [json.loads(r["line"]) for r in export.numbered_lines(spark, out).orderBy("line_no").collect()]
    assert all(list(x) == ["messages"] for x in lines) and len(lines) == 8
    assert lines[0]["messages"][0]["content"] == "Explain One, in the context of Guide 0."
    assert lines[7]["messages"][0]["content"] == "Explain Two, in the context of Guide 3."


def test_export_refuses_with_a_line_number(spark, tmp_path):
    good = json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}],
                       "provenance": {"kind": "synthetic", "template": "t"},
                       "instruction_kind": "templated_tag"})
    path = tmp_path / "d.jsonl"
    path.write_text(good + "\n\n" + good.replace('"a"', '" "') + "\n")
    with pytest.raises(export.InvalidDataset, match="line 3: message 1 has empty content"):
        export.export_provider(spark, str(path), str(tmp_path / "o"))
    path.write_text("\n \n")
    with pytest.raises(export.InvalidDataset, match="empty"):
        export.export_provider(spark, str(path), str(tmp_path / "o"))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i}\n" if i % 7 else "\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = ds.dataset_lines(spark, str(path))
        rows = lines.orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["position"] for r in rows] == list(range(20_000))
    assert all(r["line"] == (f"line {i}" if i % 7 else "") for i, r in enumerate(rows))


def test_digest_of_a_dense_table(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    df = spark.range(5).select(F.col("id").alias("position"), F.col("id").cast("string").alias("line"))
    leaf = sha("".join(sha(str(i)) for i in range(5)))
    assert ds.dataset_digest(df).first()["sha256"] == sha(sha(leaf))


def test_stored_digest_sees_every_byte(spark, tmp_path):
    def digest(name, *parts):
        folder = tmp_path / name
        folder.mkdir()
        for file, data in parts:
            (folder / file).write_bytes(data)
        return ds.stored_digest(spark, str(folder)).first()

    plain = digest("plain", ("part-00000", b"a\nb\n"))
    assert plain["lines"] == 2
    assert plain == digest("split", ("part-00000", b"a\n"), ("part-00001", b"b\n"))
    forms = [b"a\r\nb\n", b"a\nb", b"b\na\n", b"a\n\xff\n", b"a\n\xfe\n", b"a\nb\n\n", b"\n"]
    digests = {digest(f"d{i}", ("part-00000", data))["sha256"] for i, data in enumerate(forms)}
    assert len(digests | {plain["sha256"]}) == len(forms) + 1


def test_parts_are_ordered_by_number(spark, tmp_path):
    for n in (0, 9, 99_999, 100_000, 10_001, 100_001):
        (tmp_path / f"part-{n:05d}-x").write_text(f"{n}\n")
    got = ds.dataset_lines(spark, str(tmp_path)).orderBy("position").collect()
    assert [r["line"] for r in got] == ["0", "9", "10001", "99999", "100000", "100001"]
    plan = ds.dataset_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "value" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_export_is_one_scan_in_order_of_all_splits(spark, tmp_path):
    """Parts of different sizes cut into many splits come out in order; no line is shuffled."""

    folder = tmp_path / "set.jsonl"
    folder.mkdir()
    line = lambda i: json.dumps({
        "messages": [{"role": "user", "content": f"q{i}"}, {"role": "assistant", "content": "a" * (i % 90)  + "."}],
        "provenance": {"kind": "memory", "memory_id": f"m{i}"}, "instruction_kind": "templated_tag",
    })
    at = 0
    for part, n in ((0, 3), (1, 90), (2, 4), (10, 200)):
        (folder / f"part-{part:05d}-x.txt").write_text("".join(line(i) + "\n" for i in range(at, at + n)) + "\n")
        at += n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    DataFrame = type(spark.range(0))
    plans, real = [], DataFrame.sortWithinPartitions
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        DataFrame.sortWithinPartitions = lambda self, *a, **k: plans.append(self) or real(self, *a, **k)
        out = str(tmp_path / "out")
        export.export_provider(spark, str(folder), out)
        DataFrame.sortWithinPartitions = real
        assert "Exchange" not in plans[-1]._jdf.queryExecution().executedPlan().toString()
        got = [json.loads(r["line"])["messages"][0]["content"] for r in export.numbered_lines(spark, out).orderBy("line_no").collect()]
        assert got == [f"q{i}" for i in range(at)]
        with pytest.raises(FileExistsError):
            export.export_provider(spark, str(folder), out)
        (folder / "part-00007-x.txt").write_text("{}\n")
        with pytest.raises(export.InvalidDataset, match=f"line {3 + 90 + 4 + 3 + 1}: not a valid"):
            export.export_provider(spark, str(folder), str(tmp_path / "refused"))
        assert [p.name for p in tmp_path.iterdir() if "refused" in p.name] == []
    finally:
        DataFrame.sortWithinPartitions = real
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
