import pytest

from heirloom.config import FrameConfig
from heirloom.operators import frame
from pyspark.sql import functions as F

CASES = [
    (["GUIDE", "1. CORE", "Key flags"], [], "Explain Key flags, in the context of GUIDE."),
    (["Doc", "12. `Mode`:"], [], "Explain `Mode`, in the context of Doc."),
    (["Doc", "`Mode`"], [], "Explain Mode, in the context of Doc."),
    (["Rotating keys"], ["x"], "Explain Rotating keys."),
    (["Rotate", "ROTATE"], [], "Explain Rotate."),
    (["When a key rotates, drain first"], [], "Explain: When a key rotates, drain first"),
    (["Doc", "A claim made of six words"], [], "In Doc, explain: A claim made of six words"),
    (["Doc", "x" * 41], [], "In Doc, explain: " + "x" * 41),
    ([], ["mesh"], "What do you know about mesh?"),
    ([], ["mesh", "beacon"], "What do you know about mesh and beacon?"),
    ([], ["a", "b", "c", "d"], "What do you know about a, b, and c?"),
    ([], ["notes", "mesh", "2026", "2024-2026", "to:all", "WIP"], "What do you know about mesh?"),
    ([], ["from:x", "session", "7/8"], None),
    ([], [], None),
]


@pytest.mark.parametrize("path,tags,expected", CASES)
def test_instruction(spark, path, tags, expected):
    df = spark.createDataFrame([(path, tags)], "path ARRAY<STRING>, tags ARRAY<STRING>")
    assert df.select(frame.instruction(F.col("path"), F.col("tags")).alias("q")).first()["q"] == expected


def test_domain_is_opt_in(spark):
    df = spark.createDataFrame([([], ["mesh"])], "path ARRAY<STRING>, tags ARRAY<STRING>")
    asked = frame.instruction(F.col("path"), F.col("tags"), FrameConfig(domain="Atlas", max_tags=0))
    assert df.select(asked.alias("q")).first()["q"] == "What do you know about mesh in Atlas?"
