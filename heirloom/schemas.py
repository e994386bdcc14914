"""Explicit schemas. Nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

STR = T.StringType()
BIG = T.LongType()
INT = T.IntegerType()
DBL = T.DoubleType()
TS = T.TimestampType()
# Unsigned 64-bit values (session ids, nano-dollars) do not fit BIGINT.
U64 = T.DecimalType(20, 0)
STRINGS = T.ArrayType(STR)
COUNTS = T.MapType(STR, BIG)


def row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MEMORY_EXPORT = row(
    id=STR, content=STR, memory_type=STR, tags=STRINGS, agent_id=STR, salience=T.FloatType()
)

MEMORY_SNAPSHOT = row(
    id=STR, content=STR, memory_type=STR, salience=DBL, tags=STR, agent_id=STR, deleted_at=STR
)

MESSAGES = T.ArrayType(row(role=STR, content=STR))

# Member order is the order of the wire form for every kind of origin.
PROVENANCE = row(
    kind=STR,
    memory_id=STR,
    node_id=STR,
    session_id=U64,
    turn_index=INT,
    agent_id=STR,
    heading_path=STRINGS,
    template=STR,
    license_class=STR,
    model=STR,
)

EXAMPLE = row(messages=MESSAGES, provenance=PROVENANCE, instruction_kind=STR)

DATASET_REF = row(name=STR, sha256=STR)

SOURCE_SPEC = row(kind=STR, query=STR, agent_id=STR, memories_in=BIG)

DATASET_META = row(
    name=STR,
    sha256=STR,
    example_count=BIG,
    memories_used=BIG,
    rejections=COUNTS,
    rejected_total=BIG,
    framing=COUNTS,
    unframeable_chunks=BIG,
    source=SOURCE_SPEC,
    tool_version=STR,
    created_at=TS,
)

MODEL = row(
    name=STR,
    base_model=STR,
    dataset=DATASET_REF,
    job_id=STR,
    trainer_agent=STR,
    artifact=STR,
    parent=STR,
    alias_requested=STR,
    created_at=TS,
)

APPRENTICE = row(
    id=STR,
    master_agent=STR,
    name=STR,
    specialization=STR,
    base_model=STR,
    dataset=DATASET_REF,
    job_id=STR,
    model=STR,
    created_at=TS,
)

# Apprentices change: every change appends a version, the last one counts.
APPRENTICE_VERSION = T.StructType([*APPRENTICE.fields, T.StructField("version", TS)])

UPLOAD = row(file_id=STR, dataset=DATASET_REF, projected_sha256=STR, uploaded_at=TS)

JOB = row(
    id=STR,
    provider=STR,
    provider_job_id=STR,
    dataset=DATASET_REF,
    base_model=STR,
    output_name=STR,
    method=STR,
    hyperparams=row(n_epochs=INT, learning_rate=DBL, lora_r=INT, lora_alpha=INT, batch_size=INT),
    trainer_agent=STR,
    compute=row(kind=STR, name=STR),
    submitted_at=TS,
    terminal=row(outcome=STR, observed_at=TS, artifact=STR, error=STR),
    cancel_requested_at=TS,
    total_price_nanodollars=U64,
    ledger_refs=STRINGS,
)

TRAINER_STATE = row(log_history=T.ArrayType(row(loss=DBL, epoch=DBL)))

TRACE_BUNDLE = row(
    node_id=STR,
    exported_at=STR,
    sessions=T.ArrayType(row(session_id=U64, agent_id=STR, model=STR, license_class=STR)),
)
