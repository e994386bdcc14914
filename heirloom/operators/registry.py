"""Models, apprentices, uploads: audits, and the writes the registry allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heirloom.config import ConvertConfig
from heirloom.operators import convert as conv
from heirloom.operators import lineage
from heirloom.schemas import APPRENTICE, APPRENTICE_VERSION, MODEL
from heirloom.session import materialize
from heirloom.sinks import dataset as ds
from heirloom.sources.registry import read_table

NO_MODEL_NOTE = "this apprentice has no model yet — there is nothing to walk"


class AlreadyExists(ValueError):
    pass


class RecordNotFound(LookupError):
    pass


def is_trained(model: Column) -> Column:
    """Derived on read; a stored flag could contradict the model column."""
    return model.isNotNull()


def newest_first(records: DataFrame, time: str, key: str) -> DataFrame:
    return records.orderBy(F.col(time).desc(), F.col(key))


# ------------------------------------------------------------------ audits


def binding_audit(submitted: DataFrame, bindings: DataFrame) -> DataFrame:
    """Per submitted file: ``bound``, ``unbound`` or ``mismatch``.

    Both sides carry ``file_id`` and a ``dataset`` with a hash.
    """
    bound = bindings.select("file_id", F.col("dataset.sha256").alias("_bound"))
    return (
        submitted.join(bound, "file_id", "left")
        .withColumn(
            "binding",
            F.when(F.col("_bound").isNull(), "unbound")
            .when(F.col("_bound") != F.col("dataset.sha256"), "mismatch")
            .otherwise("bound"),
        )
        .withColumnRenamed("_bound", "bound_sha256")
    )


def _missing(refs: DataFrame, kind: str, owner: str, ref: str, targets: DataFrame) -> DataFrame:
    """References of one kind without a target; ``targets`` has one column ``_t``."""
    return (
        refs.where(F.col(ref).isNotNull())
        .join(targets, F.col(ref) == F.col("_t"), "left_anti")
        .select(
            F.lit(kind).alias("kind"), F.col(owner).alias("record"), F.col(ref).alias("missing")
        )
    )


def dangling_refs(apprentices: DataFrame, models: DataFrame, jobs: DataFrame) -> DataFrame:
    """References to jobs and models that are not there."""
    names = models.select(F.col("name").alias("_t"))
    ids = jobs.select(F.col("id").alias("_t"))
    return (
        _missing(apprentices, "apprentice_job", "id", "job_id", ids)
        .unionByName(_missing(apprentices, "apprentice_model", "id", "model", names))
        .unionByName(_missing(models, "model_parent", "name", "parent", names))
    )


def apprentice_lineage(
    apprentices: DataFrame, models: DataFrame, walk: DataFrame
) -> DataFrame:
    """Each apprentice with the walk of its model; untrained ones with a note."""
    steps = walk.select(
        F.col("start").alias("_start"), "generation", F.col("model").alias("ancestor")
    )
    return apprentices.join(steps, F.col("model") == F.col("_start"), "left").select(
        F.col("id").alias("apprentice"),
        "model",
        is_trained(F.col("model")).alias("trained"),
        "generation",
        "ancestor",
        F.when(~is_trained(F.col("model")), NO_MODEL_NOTE).alias("note"),
    )


def lineage_event(
    event: Column,
    model: Column,
    dataset: Column,
    dataset_sha256: Column,
    trainer_agent: Column,
    agent_id: Column,
    detail: Column,
) -> Column:
    """An event of the training history in the shape of a memory.

    The trainer rides in the text: ``agent_id`` is whoever records the event.
    """
    tags = F.concat(
        F.array(
            F.lit("nursery"),
            F.concat(F.lit("nursery:"), event),
            F.concat(F.lit("model:"), model),
        ),
        F.when(dataset.isNull(), F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("dataset:"), dataset))
        ),
    )
    hash_line = F.concat(
        F.lit("\ndataset: "), dataset, F.lit(" ("), dataset_sha256, F.lit(")")
    )
    content = F.concat(
        F.lit("[nursery:"), event, F.lit("] "), model, F.lit(" — "), detail,
        F.lit("\ntrainer_agent: "), trainer_agent, F.coalesce(hash_line, F.lit("")),
    )
    return F.struct(
        content.alias("content"),
        F.lit("episodic").alias("memory_type"),
        tags.alias("tags"),
        agent_id.alias("agent_id"),
        F.lit(0.8).alias("salience"),
    )


# ------------------------------------------------------------------ writes


def check_registrations(
    candidates: DataFrame, models: DataFrame, dataset_meta: DataFrame, order: str
) -> DataFrame:
    """Candidate models with the hash their sidecar gives, or why they are refused.

    ``refusal`` is NULL for acceptable rows. The batch is judged as if its candidates
    came one by one in ``order``: of a name the first that passes is accepted, and what
    is accepted can be the parent of what comes later. A round lets children of accepted
    models in, so there are as many rounds as generations in the batch.
    """
    meta = dataset_meta.select(
        F.col("name").alias("dataset_name"), F.col("sha256").alias("dataset_sha256")
    )
    names = models.select(F.col("name"), F.lit(True).alias("_taken"))
    parents = models.select(F.col("name").alias("parent"), F.lit(True).alias("_has_parent"))
    own = F.when(ds.invalid_name(F.col("name")), "invalid_name").when(
        F.col("dataset_name").isNotNull() & F.col("dataset_sha256").isNull(), "dataset_missing"
    )
    known = F.col("parent").isNull() | F.col("_has_parent").isNotNull()
    judged = materialize(
        candidates.join(meta, "dataset_name", "left")
        .join(parents, "parent", "left")
        .join(names, "name", "left")
        .select(
            *[c for c in candidates.columns],
            "dataset_sha256",
            own.alias("_own"),
            known.alias("_known"),
            F.col("_taken").isNotNull().alias("_taken"),
        ),
        "candidates",
    )

    def with_parents(accepted: DataFrame | None) -> DataFrame:
        if accepted is None:
            return judged.withColumn("_parent_ok", F.col("_known"))
        earlier = accepted.select(F.col("name").alias("parent"), F.col("_first").alias("_parent_at"))
        later = F.coalesce(F.col("_parent_at") < F.col(order), F.lit(False))
        return (
            judged.join(earlier, "parent", "left")
            .withColumn("_parent_ok", F.col("_known") | later)
            .drop("_parent_at")
        )

    accepted, mark = None, None
    while True:
        passing = with_parents(accepted).where("_own IS NULL AND _parent_ok AND NOT _taken")
        accepted = materialize(passing.groupBy("name").agg(F.min(order).alias("_first")), "accepted")
        now = tuple(accepted.agg(F.count(F.lit(1)), F.sum(F.xxhash64("name", "_first").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    first = F.coalesce(F.col("_first") == F.col(order), F.lit(False))
    return (
        with_parents(accepted)
        .join(accepted, "name", "left")
        .withColumn(
            "refusal",
            F.when(F.col("_own").isNotNull(), F.col("_own"))
            .when(~F.col("_parent_ok"), "parent_missing")
            .when(~first, "already_exists"),
        )
        .drop("_own", "_known", "_taken", "_parent_ok", "_first")
    )


def register_model(
    spark: SparkSession,
    root: str,
    name: str,
    base_model: str,
    trainer_agent: str,
    dataset_name: str | None = None,
    parent: str | None = None,
    job_id: str | None = None,
    artifact: str | None = None,
) -> DataFrame:
    """Append one model. The dataset hash is read from its sidecar, never passed in."""
    ds.check_name(name)
    reference = None
    if dataset_name is not None:
        row = ds.read_meta(spark, f"{root}/datasets", dataset_name).first()
        reference = (row["name"], row["sha256"])
    models = read_table(spark, f"{root}/models", MODEL)
    if parent is not None and models.where(F.col("name") == parent).isEmpty():
        raise RecordNotFound(f"parent {parent!r} is not in the registry")
    if not models.where(F.col("name") == name).isEmpty():
        raise AlreadyExists(f"model {name!r} exists")
    record = spark.createDataFrame(
        [(name, base_model, reference, job_id, trainer_agent, artifact, parent, None, None)], MODEL
    ).withColumn("created_at", F.current_timestamp())
    record.write.mode("append").parquet(f"{root}/models")
    return record


def bind_upload(
    spark: SparkSession, root: str, file_id: str, dataset_name: str, projected: str
) -> DataFrame:
    """Append which dataset an uploaded file holds, with the hash of what was projected."""
    row = ds.read_meta(spark, f"{root}/datasets", dataset_name).first()
    digest = ds.stored_digest(spark, projected).first()["sha256"]
    record = spark.createDataFrame(
        [(file_id, (row["name"], row["sha256"]), digest)],
        "file_id STRING, dataset STRUCT<name: STRING, sha256: STRING>, projected_sha256 STRING",
    ).withColumn("uploaded_at", F.current_timestamp())
    record.write.mode("append").parquet(f"{root}/uploads")
    return record


def append_events(events: DataFrame, root: str, column: str = "event") -> None:
    """Append lineage events (see ``lineage_event``) to the events of a registry."""
    stamped = events.select(f"{column}.*").withColumn("recorded_at", F.current_timestamp())
    stamped.write.mode("append").parquet(f"{root}/events")


def latest_versions(versions: DataFrame, key: str = "id") -> DataFrame:
    """The last version of each record. Reduced per task before the shuffle."""
    return (
        versions.groupBy(key)
        .agg(F.max_by(F.struct("*"), "version").alias("_r"))
        .select("_r.*")
    )


def apprentices(spark: SparkSession, root: str) -> DataFrame:
    """Current apprentices, newest first."""
    table = read_table(spark, f"{root}/apprentices", APPRENTICE_VERSION)
    return newest_first(latest_versions(table), "created_at", "id")


def append_version(current: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """New versions of records whose ``column`` changes.

    ``changes`` holds ``id``, ``value`` and ``version``; ids that do not exist
    give no row.
    """
    return (
        current.drop("version")
        .join(changes.select("id", "value", "version"), "id")
        .withColumn(column, F.col("value"))
        .drop("value")
    )


def attach(
    spark: SparkSession, root: str, apprentice: str, column: str, value: str, targets: DataFrame
) -> DataFrame:
    """Set an apprentice's ``job_id`` or ``model``; the target has to exist.

    ``targets`` has the key of the referenced records as its first column.
    """
    if column not in ("job_id", "model"):
        raise ValueError(f"cannot attach {column!r}")
    if targets.where(F.col(targets.columns[0]) == value).isEmpty():
        raise RecordNotFound(f"{column} {value!r} is not recorded")
    current = apprentices(spark, root).where(F.col("id") == apprentice)
    if current.isEmpty():
        raise RecordNotFound(f"no apprentice {apprentice!r}")
    # Later than the last version whatever the clock says, so no change is lost to a tie.
    last = F.lit(current.first()["version"]).cast("timestamp")
    changes = spark.createDataFrame([(apprentice, value)], "id STRING, value STRING").withColumn(
        "version", F.greatest(F.current_timestamp(), last + F.expr("INTERVAL '0.000001' SECOND"))
    )
    updated = append_version(current, changes, column).select(*current.columns)
    updated.write.mode("append").parquet(f"{root}/apprentices")
    return apprentices(spark, root).where(F.col("id") == apprentice)


def create_apprentice(
    spark: SparkSession,
    root: str,
    apprentice_id: str,
    master_agent: str,
    name: str,
    specialization: str,
    base_model: str,
    dataset_name: str,
    memories: DataFrame,
    cfg: ConvertConfig = ConvertConfig(),
) -> DataFrame:
    """Convert memories, write the dataset, append an untrained apprentice.

    A known id and a conversion without examples are refused before anything is
    registered.
    """
    ds.check_name(apprentice_id)
    if not apprentices(spark, root).where(F.col("id") == apprentice_id).isEmpty():
        raise AlreadyExists(f"apprentice {apprentice_id!r} exists")
    outcomes = materialize(conv.convert(memories, cfg), "outcomes")
    meta = ds.write_dataset(
        f"{root}/datasets",
        dataset_name,
        outcomes,
        conv.examples(outcomes, cfg),
        "snapshot_query",
        query=specialization,
        agent_id=master_agent,
    ).first()
    record = spark.createDataFrame(
        [
            (
                apprentice_id,
                master_agent,
                name,
                specialization,
                base_model,
                (meta["name"], meta["sha256"]),
                None,
                None,
                None,
            )
        ],
        APPRENTICE,
    ).withColumn("created_at", F.current_timestamp())
    record.withColumn("version", F.col("created_at")).write.mode("append").parquet(
        f"{root}/apprentices"
    )
    return record


def resolve_lineage(
    models: DataFrame, dataset_meta: DataFrame, apprentices_table: DataFrame, name: str
) -> DataFrame:
    """Lineage of a model, or of the model of the apprentice with that id."""
    try:
        return lineage.lineage_of(models, dataset_meta, name)
    except lineage.UnknownModel:
        row = apprentices_table.where(F.col("id") == name).select("model").first()
        if row is None:
            raise
        if row["model"] is None:
            return lineage.annotate(
                models.limit(0).select(
                    F.col("name").alias("start"),
                    F.lit(0).cast("bigint").alias("generation"),
                    F.col("name").alias("model"),
                ),
                models,
                dataset_meta,
            )
        return lineage.lineage_of(models, dataset_meta, row["model"])
