import time

import pytest
from conftest import LONG
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from heirloom.config import ChunkConfig
from heirloom.operators import chunk


def chunks(spark, text, **cfg):
    df = spark.createDataFrame([(text,)], "content STRING")
    row = chunk.with_chunks(df, "content", ChunkConfig(**cfg)).first()
    return [(c["heading_path"], c["body"]) for c in row["chunks"] or []]


def test_unsectioned_text_stays_whole(spark):
    assert chunks(spark, "  " + LONG + "\n") == [([], LONG)]


def test_blank_text_gives_nothing(spark):
    assert chunks(spark, " \n\t ") == []


def test_sections_carry_their_trail(spark):
    doc = f"ROUTER GUIDE\n\n## 1. Start:\n\n{LONG}\n\n### Flags\r\n\r\n{LONG}\n"
    assert chunks(spark, doc) == [
        (["ROUTER GUIDE", "1. Start"], LONG),
        (["ROUTER GUIDE", "1. Start", "Flags"], LONG),
    ]


def test_deeper_headings_do_not_leak_and_levels_may_be_skipped(spark):
    doc = "Doc\n\n## A\n\n#### A1\n\none\n\n### A2\n\ntwo\n\n## B\n\nthree"
    assert chunks(spark, doc, min_section=1) == [
        (["Doc", "A", "A1"], "one"),
        (["Doc", "A", "A2"], "two"),
        (["Doc", "B"], "three"),
    ]


def test_short_section_merges_forward_under_the_earlier_path(spark):
    doc = f"Doc\n\n## Frame\n\ntiny\n\n### Detail\n\n{LONG}\n\n## Tail\n\nend"
    assert chunks(spark, doc) == [(["Doc", "Frame"], f"tiny\n\n{LONG}"), (["Doc", "Tail"], "end")]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_merging_and_trails_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(chunk, "BLOCK", block)
    lengths = [3, 9, 40, 1, 2, 60, 50, 4, 4, 30, 8]
    doc = "Doc\n\n" + "\n\n".join(f"{'#' * (2 + i % 3)} H{i}\n\n{'x' * n}" for i, n in enumerate(lengths))
    want, carry, trail = [], None, []
    for i, n in enumerate(lengths):
        trail = [*[t for t in trail if t[0] < i % 3], (i % 3, f"H{i}")]
        path, body = carry or (["Doc", *[t[1] for t in trail]], None)
        body = "x" * n if body is None else body + "\n\n" + "x" * n
        carry = (path, body) if len(body) < 20 else None
        if not carry:
            want.append((path, body))
    want += [carry] if carry else []
    assert chunks(spark, doc, min_section=20, max_chunk=100_000 + block) == want


def test_many_short_sections_cost_time_in_proportion(spark):
    def seconds(n):
        doc = "Doc\n\n" + "\n\n".join(f"## H{i}\n\nbody {i}" for i in range(n))
        begun = time.monotonic()
        got = chunks(spark, doc, min_section=4)
        assert len(got) == n and got[-1] == (["Doc", f"H{n - 1}"], f"body {n - 1}")
        return time.monotonic() - begun

    seconds(100)
    small, large = seconds(5_000), seconds(50_000)
    assert large < 30 * small + 5


def test_preamble_without_title_keeps_its_first_line(spark):
    doc = f"{LONG}\nmore\n## S\n{LONG}"
    assert chunks(spark, doc) == [([], f"{LONG}\nmore"), (["S"], LONG)]


def test_title_rules(spark):
    def title(first):
        got = chunks(spark, f"{first}\n\n{LONG}")
        assert len(got) == 1
        return got[0][0]

    assert title("Short banner") == ["Short banner"]
    assert title("# Hash title.") == ["Hash title."]
    assert title("This is a sentence.") == []
    assert title("x" * 121) == []
    assert title("procedure: " + "y" * 150 + ".") == ["procedure: " + "y" * 150 + "."]
    assert title("FIELD LOOP — " + "z" * 150 + ".") == ["FIELD LOOP — " + "z" * 150 + "."]
    assert title("Deploy the binary to every board in the rack: (1) test — all pass.") == []
    assert title("####### seven") == ["seven"]
    assert title("##") == []


def test_packing_only_cuts_at_blank_lines(spark):
    para = "word " * 60
    body = "\n\n".join([para.strip()] * 10)
    got = chunks(spark, body, max_chunk=800)
    assert len(got) > 1
    assert "\n\n".join(b for _, b in got) == body
    assert all(len(b) <= 800 for _, b in got)


def test_packing_counts_bytes_but_the_limit_test_counts_characters(spark):
    body = "é" * 60 + "\n\n" + "é" * 60
    assert len(chunks(spark, body, max_chunk=122)) == 1
    assert len(chunks(spark, body, max_chunk=121)) == 2
    assert chunks(spark, "é" * 300, max_chunk=100)[0][1] == "é" * 300


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab .\n#é", max_size=40), max_size=12))
def test_no_text_is_lost(spark, parts):
    doc = "\n".join(parts)
    df = spark.createDataFrame([(doc,)], "content STRING")
    outlined = chunk.with_outline(df, "content").first()
    kept = "".join("".join(b for _, b in chunks(spark, doc, min_section=5, max_chunk=30)).split())
    headings = {h["pos"] for h in outlined["_heads"] or []}
    if outlined["_text"] is None:
        assert kept == ""
    elif not headings:
        assert kept == "".join(outlined["_text"].split())
    else:
        body = [x for i, x in enumerate(outlined["_lines"]) if i not in headings]
        assert kept == "".join("".join(body).split())
