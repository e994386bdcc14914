import json

from conftest import LONG, memory
from pyspark.sql import functions as F

from heirloom.config import ChunkConfig, ConvertConfig
from heirloom.operators import convert
from heirloom.operators import examples as ex
from heirloom.operators import gate

PLAIN = LONG + " It ends in a full stop."


def batch():
    doc = f"EXPORT GUIDE\n\n## Draining\n\n{LONG}\n\n## Rotating\n\n{LONG}\n"
    return [
        memory("doc", doc),
        memory("tagged", PLAIN, tags=["mesh", "beacon"]),
        memory("bare", PLAIN, tags=["notes"]),
        memory("short", "nope"),
        memory("episodic", LONG, "episodic"),
        memory("chatty", f"Hey ops! {LONG}"),
    ]


def test_accounting_is_total(memories):
    out = convert.convert(memories(*batch()))
    assert {r["memory_id"]: r["verdict"] for r in out.collect()} == {
        "doc": "used",
        "tagged": "used",
        "bare": "unframeable",
        "short": "too_short",
        "episodic": "type_excluded",
        "chatty": "chatter",
    }
    s = convert.summary(out).first()
    assert s["memories_used"] + s["rejected"] == s["memories_in"] == 6
    assert (s["examples"], s["framed_heading"], s["framed_tag"], s["unframeable_chunks"]) == (3, 2, 1, 1)


def test_examples_keep_the_text_verbatim_and_name_their_origin(memories):
    made = convert.examples(convert.convert(memories(*batch()))).orderBy("example_key").collect()
    assert [m["messages"][0]["content"] for m in made] == [
        "Explain Draining, in the context of EXPORT GUIDE.",
        "Explain Rotating, in the context of EXPORT GUIDE.",
        "What do you know about mesh and beacon?",
    ]
    assert all(m["messages"][1]["content"] in (LONG, PLAIN) for m in made)
    assert made[1]["provenance"]["heading_path"] == ["EXPORT GUIDE", "Rotating"]


def test_wire_form_omits_what_is_absent(memories):
    rows = memories(memory("m1", PLAIN, tags=["mesh"], agent=None))
    line = convert.examples(convert.convert(rows)).select(ex.to_jsonl().alias("l")).first()["l"]
    assert "\n" not in line
    assert json.loads(line)["provenance"] == {"kind": "memory", "memory_id": "m1"}
    assert list(json.loads(line)) == ["messages", "provenance", "instruction_kind"]


def test_two_unframeable_chunks_are_one_rejection(memories):
    rows = memories(memory("m", f"{PLAIN}\n\n{PLAIN}"))
    out = convert.convert(rows, ConvertConfig(chunk=ChunkConfig(max_chunk=200))).first()
    assert (out["verdict"], out["unframeable_chunks"], out["framed"]) == ("unframeable", 2, [])


def test_partitioning_changes_nothing(memories):
    one = convert.examples(convert.convert(memories(*batch(), partitions=1)))
    many = convert.examples(convert.convert(memories(*batch(), partitions=5)))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one) == key(many)


def test_the_conversion_is_one_map_stage(memories):
    out = convert.examples(convert.convert(memories(*batch())))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_filter_on_the_verdict_does_not_run_the_gate_again(memories):
    kept = gate.with_verdict(memories(*batch())).where(F.col("verdict") == "pass")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("type_excluded") == 1
