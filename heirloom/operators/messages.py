"""Strict decoding of session lines into typed blocks.

``from_json`` with a schema would turn a missing or ill-typed member into NULL;
here such a line has to be rejected. Lines are parsed to VARIANT once and every
member is tested for presence and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirloom.functions import text as t
from heirloom.functions.memo import per_application
from heirloom.session import evaluated_once

# Members every known block type must carry, with their JSON type.
BLOCK_MEMBERS = {
    "text": {"text": "STRING"},
    "thinking": {"thinking": "STRING", "signature": "STRING"},
    "tool_use": {"id": "STRING", "name": "STRING", "input": None},
    "tool_result": {"tool_use_id": "STRING", "content": None, "is_error": "BOOLEAN"},
    "image": {"media_type": "STRING", "data": "STRING"},
}


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def as_string(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def has_type(v: Column, json_type: str) -> Column:
    return F.coalesce(F.schema_of_variant(v) == json_type, F.lit(False))


def valid_block(b: Column) -> Column:
    """A typed block with all its members, or a block of some unknown type."""
    kind = as_string(b, "type")
    verdict = F.when(~has_type(member(b, "type"), "STRING"), F.lit(False))
    for name, members in BLOCK_MEMBERS.items():
        ok = F.lit(True)
        for field, json_type in members.items():
            value = member(b, field)
            ok = ok & (value.isNotNull() if json_type is None else has_type(value, json_type))
        verdict = verdict.when(kind == name, ok)
    return verdict.otherwise(F.lit(True))


def value_text(v: Column) -> Column:
    """A JSON string as its text, any other value as compact JSON."""
    return F.when(has_type(v, "STRING"), v.try_cast("string")).otherwise(F.to_json(v))


def typed_block(b: Column) -> Column:
    result = member(b, "content")
    kind = as_string(b, "type")
    return F.struct(
        kind.alias("type"),
        F.when(kind == "text", as_string(b, "text")).alias("text"),
        F.when(kind == "thinking", as_string(b, "thinking")).alias("thinking"),
        F.when(kind == "thinking", as_string(b, "signature")).alias("signature"),
        F.when(kind == "tool_use", as_string(b, "name")).alias("name"),
        F.when(kind == "tool_use", F.to_json(member(b, "input"))).alias("input_json"),
        F.when(kind == "tool_result", value_text(result)).alias("result_text"),
        F.when(kind == "tool_result", F.try_variant_get(b, "$.is_error", "boolean")).alias(
            "is_error"
        ),
    )


@per_application
def _sound_message() -> Column:
    return F.coalesce(
        F.col("_role").isin("user", "assistant")
        & F.forall("_content", lambda b: F.coalesce(valid_block(b), F.lit(False))),
        F.lit(False),
    )


@per_application
def _typed_blocks() -> Column:
    return F.transform("_content", typed_block)


def decode(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``role`` and ``blocks``; both are NULL for a line that is not a message.

    Blank lines are dropped. All other columns stay.
    """
    parsed = lines.where(t.not_blank(F.col(line))).withColumn(
        "_v", t.strict_json(F.col(line))
    )
    shaped = parsed.withColumn(
        "_role",
        F.when(has_type(member(F.col("_v"), "role"), "STRING"), as_string(F.col("_v"), "role")),
    ).withColumn("_content", F.try_variant_get("_v", "$.content", "array<variant>"))
    sound = _sound_message()
    decoded = (
        shaped.withColumn("_ok", sound)
        .withColumn("role", F.when(F.col("_ok"), F.col("_role")))
        .withColumn("blocks", F.when(F.col("_ok"), _typed_blocks()))
        .drop("_v", "_role", "_content", "_ok", line)
    )
    return evaluated_once(decoded, "role", "blocks")


def starts_round(role: Column, blocks: Column) -> Column:
    """A user message with text opens a round; a bare tool result does not."""
    return (role == "user") & F.exists(
        blocks, lambda b: F.coalesce(t.not_blank(b["text"]), F.lit(False))
    )
