import hashlib
import itertools
import random
import re
import zlib

import pytest

from heirloom.llm import repair
from heirloom.llm.queries import op12_conversation_repair, table

LEGAL = re.compile(r"(s?(ua)+)?")
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """blank, duplicate, truncated or nothing for each (role, text)."""
    seen, out = set(), []
    for row in rows:
        solid = SOLID.findall(row[1])
        out.append(
            "blank" if not solid else "duplicate" if row in seen else "truncated" if solid[-1] not in ".!?" else ""
        )
        seen.add(row)
    return out


def every_edit(rows):
    """The cheapest of all edits with up to two insertions at a place, tried one by one."""
    found = faults(rows)
    best = None
    for ways in itertools.product("DKR", repeat=len(rows)):
        if any(w != "D" and f in ("blank", "duplicate") for w, f in zip(ways, found, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit, initials, cost = "", "", 0
            roles = []
            for k, n in enumerate(inserts):
                audit += "I" * n
                roles += [None] * n
                cost += 2 * n
                if k < len(rows):
                    audit += ways[k]
                    cost += {"D": 3, "K": 0, "R": 2}[ways[k]] + (ways[k] != "D" and found[k] == "truncated")
                    roles += {"D": [], "K": [rows[k][0][:1]], "R": [None]}[ways[k]]
            if best and (cost, audit) >= best:
                continue
            # Free roles can take either value; alternation leaves at most one way to fill them.
            for start in ("s", ""):
                want = start + "ua" * len(roles)
                initials = want[: len(roles)]
                if all(r in (None, i) for r, i in zip(roles, initials, strict=True)) and not (start and roles and roles[0] is None):
                    if LEGAL.fullmatch(initials):
                        best = cost, audit
    return best


def plain(codes):
    """The same recursion on pairs of cost and audit."""
    far = (10**9, "")
    after = [(0, ""), far, far, (0, "")]

    def with_inserts(base):
        got = base
        for _ in range(2):
            got = [min(base[s], (got[repair.NEXT[s]][0] + 2, "I" + got[repair.NEXT[s]][1])) for s in range(4)]
        return got

    after = with_inserts(after)
    for code in reversed(codes):
        best = []
        more = 1 if code & repair.CUT_SHORT else 0
        kept, states = repair.KEPT.get(repair.INITIALS[code & 3], (0, ()))
        for s in range(4):
            ways = [(after[s][0] + 3, "D" + after[s][1])]
            if not code & repair.MUST_GO:
                to = after[repair.NEXT[s]]
                ways.append((to[0] + 2 + more, "R" + to[1]))
                if s in states:
                    ways.append((after[kept][0] + more, "K" + after[kept][1]))
            best.append(min(ways))
        after = with_inserts(best)
    return after[0]


def code_of(role, fault):
    kind = repair.INITIALS.find(role[:1]) if role[:1] else 3
    flag = {"blank": repair.MUST_GO, "duplicate": repair.MUST_GO, "truncated": repair.CUT_SHORT}.get(fault, 0)
    return (kind if kind >= 0 else 3) | flag


def test_every_edit_of_short_conversations():
    rng = random.Random(4)
    for _ in range(150):
        rows = [
            (rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "no", " ", f"{rng.random()}!"]))
            for _ in range(rng.randrange(5))
        ]
        codes = bytes(code_of(role, fault) for (role, _), fault in zip(rows, faults(rows), strict=True))
        assert repair.cheapest(codes) == every_edit(rows)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 128])
def test_blocks_change_nothing(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    kinds = [[*range(12)], [0, 1, 2], [1, 2, 9, 10], [1], [2, 3], [4, 5], [1, 1, 1, 2, 6]]
    for _ in range(1500):
        codes = bytes(rng.choices(rng.choice(kinds), k=rng.randrange(30)))
        assert repair.cheapest(codes) == plain(codes)


def test_time_grows_with_the_rows():
    codes = bytes(random.Random(1).choices(range(12), k=60_000))
    cost, audit = repair.cheapest(codes)
    assert len(audit) >= len(codes) and cost > 0
    assert repair.cheapest(codes[:5000]) == plain(codes[:5000])


def brute(rows):
    """The contract on plain rows (conv_id, turn, role, text): a dict of results by conversation."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv_id):
            key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
            dealt = zlib.crc32(key.encode()) % 20
            role, text = (" " if x is None else x for x in (role, text))
            text = "" if dealt == 1 else re.sub("[.!?]", "", text) if dealt == 2 else text
            kept += [(turn, "user" if dealt == 4 else role, text)] * {0: 0, 3: 2}.get(dealt, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = {r[0] for r in kept} - {None}
        found = faults([r[1:] for r in kept])
        initials = [r[1][:1] for r in kept]
        codes = bytes(code_of(r[1], f) for r, f in zip(kept, found, strict=True))
        cost, audit = plain(codes)
        state, lines, left = 0, [], iter(kept)
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter == "D":
                continue
            state = repair.KEPT[row[1][0]][0] if letter == "K" else repair.NEXT[state]
            role = row[1] if letter == "K" else repair.ROLES[state]
            lines.append(f"{role}:{row[2] if row else ''}")
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def check(rows, got):
    found = {r[0]: tuple(r[1:]) for r in got}
    assert len(found) == len(got)
    assert found == brute(rows)


def random_rows(rng, n):
    roles = ["system", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["Yes.", "no", " \n", "", None, "é?\t", "same.", "v\x0b.\x0c", "nbsp ", "a.b"]
    return [
        (rng.choice([*range(12), None]), rng.choice([*range(8), None]), rng.choice(roles), rng.choice(texts)) for _ in range(n)
    ]


def test_report_against_brute_force(spark):
    rows = random_rows(random.Random(9), 300) + [(77, k, "user", "x.") for k in range(500)]
    lost = [t for t in range(3000) if zlib.crc32(f"88:{t}".encode()) % 20 == 0]
    rows += [(88, t, "user", "gone.") for t in lost[:3]]
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").repartition(3)
    df = df.selectExpr("*", "1 AS audit", "2 AS copies", "3 AS part", "4 AS first")
    got = repair.report(repair.damaged(df))
    assert got.columns == ["conv_id", *repair.COUNTS, "audit", "repaired_sha256"]
    check(rows, got.collect())
    assert brute(rows)[88] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_messages_are_legal(spark):
    rows = random_rows(random.Random(2), 200)
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    found = repair.audits(df)
    messages = repair.repaired(df, found).collect()
    by = {}
    for m in messages:
        by.setdefault(m.conv_id, []).append(m)
    assert set(by) == {r[0] for r in rows}
    for kept in by.values():
        if kept[0].place is None:
            assert len(kept) == 1
            continue
        assert [m.place for m in kept] == list(range(len(kept)))
        assert LEGAL.fullmatch("".join(m.role[0] for m in kept))
    assert all("copies" not in c for c in found.columns)


def test_empty_table_and_long_texts(spark):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    assert repair.report(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "long " * 400_000 + "."), (1, 1, "assistant", "ok" + "." * 100_000 + " " * 100_000)]
    got = repair.report(spark.createDataFrame(rows, schema)).first()
    assert (got.audit, got.cost, got.truncated) == ("KK", 0, 0)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf, "conversations").collect()]
    check(rows, op12_conversation_repair(spark, sf).collect())
