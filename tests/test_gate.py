import pytest
from conftest import LONG, memory
from pyspark.sql import functions as F

from heirloom.config import REJECTION_REASONS, GateConfig
from heirloom.operators import gate

CASES = [
    ("plain procedure", memory("a", LONG), "pass"),
    ("mentions a smoke test", memory("a", LONG + " Run the smoke test first."), "pass"),
    ("wrong type", memory("a", LONG, "episodic"), "type_excluded"),
    ("type comes before length", memory("a", "x", "affective"), "type_excluded"),
    ("short", memory("a", "too little"), "too_short"),
    ("padding does not count", memory("a", " 　\n" * 200 + "tiny"), "too_short"),
    ("marginal", memory("a", LONG, salience=0.1), "low_salience"),
    ("exactly the threshold", memory("a", LONG, salience=0.3), "pass"),
    ("denied tag in capitals", memory("a", LONG, tags=["A2A", "infra"]), "denied_tag"),
    ("routing tag", memory("a", LONG, tags=[" From:ops"]), "denied_tag"),
    ("denied beats dream", memory("a", LONG, tags=["dream", "ping"]), "denied_tag"),
    ("greeting", memory("a", "Hey team! " + LONG), "chatter"),
    ("address", memory("a", LONG + " Can you hear me?"), "chatter"),
    ("greeting not on the first line", memory("a", LONG + "\nhey you"), "pass"),
    ("bookmark", memory("a", "look " + "https://host.example/" * 12), "not_prose"),
    ("symbols", memory("a", "*-" * 90), "not_prose"),
    ("many links", memory("a", " ".join(["http://a.example/b"] * 20) + " tail"), "not_prose"),
]


def test_verdicts(spark, memories):
    got = gate.with_verdict(memories(*[c[1] for c in CASES])).orderBy("src_ord").collect()
    assert [(c[0], r["verdict"]) for c, r in zip(CASES, got)] == [(c[0], c[2]) for c in CASES]


@pytest.mark.parametrize(
    "tag,expected",
    [
        ("dream_extracted", True),
        (" DREAM_MERGED ", True),
        ("dream-log", True),
        ("dream", True),
        ("daydream", False),
        ("dreamy-ui", False),
        ("dreams", False),
    ],
)
def test_dream_tags(spark, memories, tag, expected):
    rows = memories(memory("a", LONG, tags=["x", tag]))
    assert rows.select(gate.dream_derived(F.col("tags")).alias("d")).first()["d"] is expected
    assert gate.with_verdict(rows).first()["verdict"] == ("dream_derived" if expected else "pass")
    admit = GateConfig(include_dream_derived=True)
    assert gate.with_verdict(rows, admit).first()["verdict"] == "pass"


def test_types_can_be_admitted_and_unknown_ones_are_an_error(memories):
    cfg = GateConfig(include_types=GateConfig.parse_types([" Episodic"]))
    assert gate.with_verdict(memories(memory("a", LONG, "episodic")), cfg).first().verdict == "pass"
    with pytest.raises(ValueError):
        GateConfig.parse_types(["dreamtime"])


def test_full_ledger_shows_zeros(memories):
    rows = gate.full_ledger(gate.with_verdict(memories(memory("a", "x"), memory("b", "y"))))
    counts = {r["reason"]: r["n"] for r in rows.collect()}
    assert set(counts) == set(REJECTION_REASONS) and counts.pop("too_short") == 2
    assert set(counts.values()) == {0}
