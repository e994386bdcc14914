"""The example record: messages, provenance and the wire form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirloom.schemas import PROVENANCE

_PROVENANCE_NAMES = [f.name for f in PROVENANCE.fields]


def messages(question: Column, answer: Column) -> Column:
    """A user turn and an assistant turn; the answer is taken verbatim."""
    return F.array(
        F.struct(F.lit("user").alias("role"), question.alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")),
    )


def provenance(kind: str, **members: Column) -> Column:
    """The origin struct. Members that are not given are NULL and stay off the wire."""
    values: dict[str, Column] = {"kind": F.lit(kind), **members}
    unknown = set(values) - set(_PROVENANCE_NAMES)
    if unknown:
        raise ValueError(f"not a provenance member: {sorted(unknown)}")
    return F.struct(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in PROVENANCE.fields
        ]
    )


def empty_to_null(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def to_jsonl(
    messages_col: str = "messages",
    provenance_col: str = "provenance",
    kind_col: str = "instruction_kind",
) -> Column:
    """One line per example; NULL members are left out."""
    return F.to_json(
        F.struct(
            F.col(messages_col).alias("messages"),
            F.col(provenance_col).alias("provenance"),
            F.col(kind_col).alias("instruction_kind"),
        ),
        {"ignoreNullFields": "true"},
    )


def memory_id(provenance_col: Column) -> Column:
    """The originating memory, NULL for other kinds of origin."""
    return provenance_col.getField("memory_id")


def from_jsonl(line: Column) -> Column:
    """Decode a stored example; NULL where the line is not one."""
    from heirloom.schemas import EXAMPLE

    schema = T.StructType(EXAMPLE.fields + [T.StructField("_corrupt", T.StringType())])
    return F.from_json(
        line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
