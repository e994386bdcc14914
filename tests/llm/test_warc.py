import gzip
import hashlib

import pytest

from heirloom.llm import warc
from heirloom.session import scratch_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, type STRING, digest INT").repartition(3)


LONG = "<p>é" + "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"


def expected(rows):
    first = {}
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        owner = first.get(data)
        again = owner is not None and i != owner
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [(i, f"http://h{i % 3}.org/p?q={i}", LONG if i % 2 else "short" * (i % 5), "t", 1) for i in range(7, 30)]
    rows += [(100, None, None, None, None), (101, "no url\r\nX: y", "", "", 1), (None, "u", LONG, "", 1), (None, None, "z" * 200, "", 1)]
    rows += [rows[0], rows[3], (9, "http://elsewhere/", LONG, "", 1)]
    got = warc.round_trip(pages(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_nested_captures_hold_the_payload(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages(spark, [(1, "http://a.org/x", LONG, "", 1), (2, "http://a.org/y", LONG, "", 1)]), path)
    found = {r.page_id: r for r in warc.captures(warc.read_records(spark, path)).collect()}
    one, two = found[1], found[2]
    assert bytes(one.response.payload).decode() == LONG and one.request.http.startswith("GET http://a.org/x HTTP/1.1\r\nHost: a.org")
    assert two.response.type == "revisit" and two.response.payload is None
    assert two.response.refers_to == one.capture_id and two.response.digest == one.response.digest
    assert one.request.target_uri == one.response.target_uri == "http://a.org/x" and "page-id: 1" in one.metadata.fields


def test_parser_takes_any_chunks_and_members():
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    plain = record * 5
    packed = b"".join(gzip.compress(record) for _ in range(5))
    for data in (plain, packed, gzip.compress(plain)):
        whole = b"".join(warc._inflated(data))
        for n in (1, 3, 1000):
            chunks = [whole[i : i + n] for i in range(0, len(whole), n)]
            assert [b for _, b in warc.parse_records(chunks)] == [b"\r\n\r\n"] * 5
    with pytest.raises(ValueError):
        list(warc.parse_records([plain[:-30]]))
