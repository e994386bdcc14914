import json

import pytest

from heirloom.config import HarvestConfig
from heirloom.operators import harvest
from heirloom.sources import sessions as src
from pyspark.sql import functions as F


def said(role, *blocks):
    return json.dumps({"role": role, "content": list(blocks)})


def text(s):
    return {"type": "text", "text": s}


def user(s):
    return said("user", text(s))


def assistant(s):
    return said("assistant", text(s))


def thinking(s, signature):
    return {"type": "thinking", "thinking": s, "signature": signature}


def call(**given):
    return {"type": "tool_use", "id": "c1", "name": "probe", "input": given}


def result(content, is_error=False):
    return {"type": "tool_result", "tool_use_id": "c1", "content": content, "is_error": is_error}


@pytest.fixture
def export(tmp_path):
    root = tmp_path / "host7"
    (root / "archive").mkdir(parents=True)

    def put(name, *lines):
        (root / name).write_text("\n".join(lines) + "\n", encoding="utf-8")

    put.root = str(root)
    return put


def mined(spark, export, **cfg):
    out, made = harvest.mine_sessions(spark, export.root, HarvestConfig(**cfg))
    return out.collect(), made.orderBy("example_key").collect()


def verdicts(rows):
    return sorted(r["verdict"] for r in rows)


def test_tool_round_becomes_one_example(spark, export):
    export(
        "session-22.jsonl",
        user("open the port for the proxy"),
        said("assistant", text("On it."), call(z=1, a=True)),
        said("user", result("listening on 8888")),
        said("user", result({"code": 5}, True)),
        assistant("The port is open."),
        "",
        user("and close it"),
        assistant("Closed."),
    )
    rows, made = mined(spark, export)
    assert verdicts(rows) == ["used", "used"]
    assert made[0]["messages"][1]["content"] == (
        'On it.\n\n🔧 `probe`({"a":true,"z":1})\n\n↳ listening on 8888\n\n⚠ {"code":5}'
        "\n\nThe port is open."
    )
    p = made[1]["provenance"]
    assert (p["node_id"], p["session_id"], p["turn_index"], p["license_class"]) == (
        "host7", 22, 1, "answer_only",
    )


def test_thinking_is_kept_only_for_listed_open_models(spark, export):
    for sid, signature in ((7, "sig"), (8, ""), (9, "")):
        export(
            f"session-{sid}.jsonl",
            user("why is the table empty"),
            said("assistant", thinking(" the lease ran out ", signature), text("done")),
        )
    stamps = [{"session_id": s, "model": "Open-9"} for s in (7, 8)]
    export("harvest.json", json.dumps({"node_id": "n1", "sessions": stamps}))
    _, made = mined(spark, export, open_prefixes=("open-",))
    by_id = {int(m["provenance"]["session_id"]): m for m in made}
    assert by_id[7]["provenance"]["license_class"] == "closed_hidden"
    assert by_id[7]["messages"][1]["content"] == "done"
    assert by_id[8]["messages"][1]["content"] == "Thinking:\nthe lease ran out\n\ndone"
    assert by_id[9]["provenance"]["license_class"] == "answer_only"
    assert by_id[8]["provenance"]["node_id"] == "n1"


def test_skipped_files_and_bad_lines_count_once_each(spark, export):
    pair = (user("question here"), assistant("answer"))
    export("session-0.jsonl", *pair)
    export(f"session-{2**63}.jsonl", *pair)
    export(f"archive/session-{2**62 + 3}.jsonl", *pair)
    export("readme.jsonl", *pair)
    export(
        "session-5.jsonl",
        *pair,
        "not json",
        said("system", text("x")),
        said("user", {"type": "text"}),
        said("user", {"type": "tool_result", "tool_use_id": "c", "content": "x"}),
        '{"role":"user","content":"plain"}',
        said("assistant", {"type": "novel", "anything": 1}),
    )
    rows, made = mined(spark, export)
    assert verdicts(rows) == sorted(
        ["session_zero", "spawn", "unparsable", *["unparsable"] * 5, "used", "used"]
    )
    assert len(made) == 2


def test_round_verdicts(spark, export):
    cases = {
        1: ("chatter", [user("Hey ops can you hear me"), assistant("yes")]),
        2: ("secret", [user("store this"), assistant("OPENAI_API_KEY=abc")]),
        3: ("empty_assistant", [user("what next"), assistant("")]),
        4: ("tool_result_too_long", [user("dump"), said("user", result("x" * 50))]),
        6: ("image_only", [said("user", {"type": "image", "media_type": "p", "data": "d"})]),
        10: ("empty_assistant", [assistant("nobody asked")]),
    }
    for sid, (_, lines) in cases.items():
        export(f"session-{sid}.jsonl", *lines)
    rows, made = mined(spark, export, max_tool_result_chars=20)
    assert {int(r["session_id"]): r["verdict"] for r in rows} == {
        k: v[0] for k, v in cases.items()
    }
    assert made == []


def test_leading_assistant_text_is_round_zero(spark, export):
    export("session-3.jsonl", assistant("before"), user("one"), assistant("a"), user("two"), assistant("b"))
    rows, _ = mined(spark, export)
    assert sorted((r["turn_index"], r["verdict"]) for r in rows) == [
        (0, "empty_assistant"), (1, "used"), (2, "used"),
    ]


def test_empty_directory_is_an_error(spark, export):
    with pytest.raises(src.NoSessionFiles):
        harvest.mine_sessions(spark, export.root)


def test_bad_sidecar_counts_as_absent(spark, export):
    export("session-3.jsonl", user("one"), assistant("a"))
    export("harvest.json", '{"node_id":"n","sessions":[{"session_id":3,"license_class":"mine"}]}')
    _, made = mined(spark, export)
    assert made[0]["provenance"]["node_id"] == "host7"


def test_closed_rounds_can_be_dropped(spark, export):
    export("session-3.jsonl", user("one"), said("assistant", thinking("t", "sig"), text("a")))
    rows, _ = mined(spark, export, drop_closed=True)
    assert verdicts(rows) == ["closed_license"]


def test_round_numbers_do_not_depend_on_block_size(spark):
    from heirloom.operators.rounds import with_turns

    opens = [1, 0, 0, 1, 0, 1, 1, 0, 0, 0, 1, 0]
    block = "ARRAY<STRUCT<type: STRING, text: STRING>>"
    rows = [(i, [("text", "hi")] if o else [("text", " ")]) for i, o in enumerate(opens)]
    base = spark.createDataFrame(rows, f"pos BIGINT, blocks {block}").select(
        F.lit("f").alias("file_path"), F.lit(1).alias("session_id"), F.lit("user").alias("role"),
        "pos", "blocks",
    )
    results = []
    for size in (1, 3, 100):
        numbered = with_turns(base.withColumn("block", F.floor(F.col("pos") / size)))
        results.append([r["turn_index"] for r in numbered.orderBy("pos").collect()])
    assert results[0] == results[1] == results[2] == [0, 0, 0, 1, 1, 2, 3, 3, 3, 3, 4, 4]


def test_messages_do_not_move_before_their_round_is_gathered(spark, export):
    """No exchange carries blocks, and turns do not depend on whether openers are sent to all tasks."""
    from heirloom.operators import rounds
    from heirloom.operators.messages import decode
    from heirloom.session import materialize

    for name in ("session-5.jsonl", "session-6.jsonl"):
        export(name, *[x for i in range(40) for x in ((user(f"ask {i}"),) if i % 3 else ()) + (assistant(f"said {i}"),)])
    lines = src.session_lines(spark, src.session_globs(spark, export.root))
    messages = materialize(decode(lines), "messages").where("role IS NOT NULL")
    found = {}
    for few in (rounds.FEW_OPENERS, 0):
        numbered = rounds.with_turns(messages, few)
        found[few] = sorted((r["session_id"], r["pos"], r["turn_index"]) for r in numbered.collect())
    assert found[rounds.FEW_OPENERS] == found[0]
    plan = rounds.with_turns(messages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan
    assert not [x for x in plan.split("\n") if "Exchange hash" in x or "Exchange range" in x or "SortMergeJoin" in x]
    turns = {}
    for sid, pos, turn in found[0]:
        turns.setdefault(sid, []).append(turn)
    opens = [bool(i % 3) and not said for i in range(40) for said in ((False, True) if i % 3 else (True,))]
    want, at = [], 0
    for k, opened in enumerate(opens):
        at += opened and k > 0
        want.append(at)
    assert list(turns.values()) == [want, want]


def test_openers_are_found_by_halving(spark):
    from heirloom.operators.rounds import _at_or_before

    places = [3, 5, 9, 10**12]
    df = spark.createDataFrame([(places, p) for p in (0, 3, 4, 5, 9, 10, 10**12, 10**13)], "places ARRAY<BIGINT>, at BIGINT")
    got = [r["n"] for r in df.select(_at_or_before(F.col("places"), F.col("at")).alias("n")).collect()]
    assert got == [0, 1, 1, 2, 3, 3, 4, 4]
    empty = spark.createDataFrame([([], 5)], "places ARRAY<BIGINT>, at BIGINT")
    assert empty.select(_at_or_before(F.col("places"), F.col("at")).alias("n")).first()["n"] == 0


def test_sidecars_of_many_hosts_are_kept_apart(spark, tmp_path):
    for host, agents in (("h1", ("ada", "bob")), ("h2", ("cyd",))):
        (tmp_path / host).mkdir()
        stamped = [{"session_id": 5, "agent_id": a} for a in agents]
        (tmp_path / host / "harvest.json").write_text(json.dumps({"node_id": host, "sessions": stamped}))
    bundles = src.read_bundle(spark, f"{tmp_path}/*")
    got = src.stamps(bundles, "node_id").orderBy("node_id").collect()
    assert [(r["node_id"], r["session_id"], r["agent_id"]) for r in got] == [("h1", 5, "ada"), ("h2", 5, "cyd")]
    assert src.stamps(bundles).count() == 1
