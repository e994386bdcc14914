"""Ancestry of models, and what it leads to: datasets and memories."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heirloom.session import materialize, materialize_counted
from heirloom.sources.lines import ranked, running_total

#: Places that one task adds up at most.
BLOCK_ROWS = 1 << 16


class UnknownModel(LookupError):
    pass


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _by_shuffle(table: DataFrame) -> DataFrame:
    """A table of up to a row a model, to be joined without sending it to all tasks.

    Spark would go by the size of its file, which packs names many times closer than the
    driver holds them, and a walk over the forest has dozens of such joins.
    """
    return table.hint("merge")


def resolve_dataset(models: DataFrame, dataset_meta: DataFrame) -> DataFrame:
    """Attach what the sidecar says about the dataset a record refers to.

    Adds ``dataset_examples``, ``dataset_memories``, ``dataset_missing`` and
    ``dataset_hash_mismatch``. A popular dataset is no problem: sidecar names are
    unique, so AQE can split the model side of a skewed key.
    """
    meta = dataset_meta.select(
        F.col("name").alias("_meta_name"),
        F.col("sha256").alias("_meta_sha"),
        F.col("example_count").alias("dataset_examples"),
        F.col("memories_used").alias("dataset_memories"),
    )
    named = F.col("dataset").isNotNull()
    return (
        models.join(meta, F.col("dataset.name") == F.col("_meta_name"), "left")
        .withColumn("dataset_missing", named & F.col("_meta_name").isNull())
        .withColumn(
            "dataset_hash_mismatch",
            F.coalesce(F.col("_meta_sha") != F.col("dataset.sha256"), F.lit(False)),
        )
        .drop("_meta_name", "_meta_sha")
    )


def parent_edges(models: DataFrame) -> DataFrame:
    """``name, parent`` for parents that are registered."""
    known = models.select(F.col("name").alias("parent"))
    return models.where(F.col("parent").isNotNull()).select("name", "parent").join(_by_shuffle(known), "parent")


@dataclass(frozen=True)
class Forest:
    """The parent edges of all models, cut where a cycle has its least name.

    ``nodes``: node, to (the registered parent, none where cut), cut, root, depth and
    size (models below, itself included). ``jumps[k]``: node and jump, its 2^k-th
    ancestor. ``rings``: root, node and back, how many generations behind the parent
    of the cut root a node of a cycle stands; none if no edge was cut.
    """

    nodes: DataFrame
    jumps: list[DataFrame]
    rings: DataFrame | None


def _doubled(state: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """Lets every node jump as far again; counts those that still jump and those that came to themselves.

    A model below within 2^(k+1) generations is below within 2^k, or so below a model
    that jumps here.
    """
    onward = state.select(
        F.col("node").alias("jump"),
        *[F.col(c).alias(f"_{c}") for c in ("jump", "root", "depth", "least")],
    )
    below = state.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("node")).agg(F.sum("size").alias("_size"))
    moved = state.join(_by_shuffle(onward), "jump", "left").join(_by_shuffle(below), "node", "left").select(
        "node",
        "to",
        "cut",
        F.col("_jump").alias("jump"),
        F.coalesce("_root", "root").alias("root"),
        (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
        F.least("least", "_least").alias("least"),
    )
    return _seen(moved, label)


def _seen(state: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    counts = [F.count("jump").alias("jumping"), F.count_if(F.col("least") == F.col("node")).alias("closed")]
    table = materialize(state.observe(seen, *counts), label)
    return table, seen.get["jumping"], seen.get["closed"]


def forest(models: DataFrame) -> Forest:
    """The labelled forest of all models, in rounds that are logarithmic in the longest chain.

    Each round has one row a model. On a cycle the least name is the least of what is
    ahead of it as soon as a jump is as long as the cycle; its edge is cut then and the
    jumps begin anew.
    """
    parents = parent_edges(models).select(F.col("name").alias("node"), F.col("parent").alias("to"))
    edges = models.select(F.col("name").alias("node")).join(_by_shuffle(parents), "node", "left")
    edges = materialize(edges.withColumn("cut", F.lit(False)), "forest-edges")
    cuts = 0
    while True:
        first = edges.select(
            "node",
            "to",
            "cut",
            F.col("to").alias("jump"),
            F.coalesce("to", "node").alias("root"),
            F.col("to").isNotNull().cast("bigint").alias("depth"),
            F.lit(1).cast("bigint").alias("size"),
            F.col("to").alias("least"),
        )
        state, jumping, closed = _seen(first, "forest")
        states = [state]
        while jumping and not closed:
            state, jumping, closed = _doubled(state, "forest")
            states.append(state)
        if not closed:
            break
        cuts += closed
        least = states[-1].where(F.col("least") == F.col("node")).select("node", F.lit(True).alias("_cut"))
        opened = edges.join(_by_shuffle(least), "node", "left").select(
            "node", F.when(F.col("_cut").isNull(), F.col("to")).alias("to"), (F.col("cut") | F.col("_cut").isNotNull()).alias("cut")
        )
        edges = materialize(opened, "forest-edges")
    jumps = [s.where(F.col("jump").isNotNull()).select("node", "jump") for s in states[:-1]]
    found = Forest(state.select("node", "to", "cut", "root", "depth", "size"), jumps, None)
    if not cuts:
        return found
    entered = found.nodes.where("cut").select(F.col("node").alias("name"))
    behind = models.join(_by_shuffle(entered), "name").select(F.col("name").alias("root"), F.col("parent").alias("start"))
    rings = _paths(found, behind.select("start")).join(_by_shuffle(behind), "start")
    rings = materialize(rings.select("root", F.col("model").alias("node"), F.col("generation").alias("back")), "forest-rings")
    return replace(found, rings=rings)


def _paths(trees: Forest, starts: DataFrame) -> DataFrame:
    """``start, generation, model`` up to the root of each start; a round adds as many generations as there are."""
    known = trees.nodes.select(F.col("node").alias("start"))
    pairs = known.join(_by_shuffle(starts.select("start").distinct()), "start", "left_semi")
    pairs = [materialize(pairs.select("start", F.lit(0).cast("bigint").alias("generation"), F.col("start").alias("model")), "paths")]
    for k, jump in enumerate(trees.jumps):
        further = _union(pairs).join(_by_shuffle(jump), F.col("model") == F.col("node")).select(
            "start", (F.col("generation") + 2**k).alias("generation"), F.col("jump").alias("model")
        )
        further, n = materialize_counted(further, "paths")
        if n == 0:
            break
        pairs.append(further)
    return _union(pairs)


def _nearest(trees: Forest, marks: DataFrame) -> DataFrame:
    """``node, away, mark``: the mark of the nearest marked model up to the root, and how far it is.

    ``marks(node, mark)`` has some models. One row a model, a round for each jump.
    """
    none = F.struct(F.lit(None).cast("bigint").alias("away"), F.lit(None).cast("bigint").alias("mark"))
    own = F.when(F.col("mark").isNotNull(), F.struct(F.lit(0).cast("bigint").alias("away"), "mark")).otherwise(none)
    near = trees.nodes.select("node").join(_by_shuffle(marks), "node", "left").select("node", F.when(F.col("mark").isNotNull(), own).alias("near"))
    for k, jump in enumerate(trees.jumps):
        ahead = near.select(F.col("node").alias("jump"), F.col("near").alias("_near"))
        there = F.when(
            F.col("_near").isNotNull(), F.struct((F.col("_near.away") + 2**k).alias("away"), F.col("_near.mark").alias("mark"))
        )
        moved = near.join(_by_shuffle(jump), "node", "left").join(_by_shuffle(ahead), "jump", "left")
        near = materialize(moved.select("node", F.coalesce("near", there).alias("near")), "nearest")
    return near.select("node", "near.away", "near.mark")


def chain_ends(models: DataFrame, trees: Forest | None = None) -> DataFrame:
    """(start, last_generation, last_model): where the walk of every model ends.

    One row for each model all along. A walk ends at a root, or where a cycle comes
    round to the model at which it was entered.
    """
    trees = trees or forest(models)
    plain = trees.nodes.select(F.col("node").alias("start"), "root", "depth")
    if trees.rings is None:
        return plain.select("start", F.col("depth").alias("last_generation"), F.col("root").alias("last_model"))
    # From the cut root a walk goes on to its parent and comes round to where it entered.
    entered = _nearest(trees, trees.rings.select("node", F.col("back").alias("mark")))
    last = trees.rings.select("root", (F.col("back") + 1).alias("mark"), F.col("node").alias("_last"))
    marked = plain.join(_by_shuffle(entered.select(F.col("node").alias("start"), "mark")), "start")
    return marked.join(_by_shuffle(last), ["root", "mark"], "left").select(
        "start",
        (F.col("depth") + F.coalesce("mark", F.lit(0))).alias("last_generation"),
        F.coalesce("_last", "root").alias("last_model"),
    )


def ancestry(models: DataFrame, starts: DataFrame | None = None, trees: Forest | None = None) -> DataFrame:
    """Models with each of their ancestors: ``start, generation, model``.

    ``starts(start)`` names the models whose walks are wanted, all if it is left out;
    only these are expanded, to a row for each generation of each.
    """
    trees = trees or forest(models)
    paths = _paths(trees, starts if starts is not None else trees.nodes.select(F.col("node").alias("start")))
    if trees.rings is None:
        return paths
    entered = paths.join(trees.rings.select("root", F.col("node").alias("model"), "back"), "model")
    entered = entered.groupBy("start", "root").agg(F.min("back").alias("_entry"))
    depth = trees.nodes.select(F.col("node").alias("start"), "depth")
    rest = entered.join(depth, "start").join(trees.rings, "root").where(F.col("back") < F.col("_entry"))
    return paths.unionAll(rest.select("start", F.col("depth") + 1 + F.col("back"), "node"))


def labelled(trees: Forest) -> DataFrame:
    """The nodes with ``pre``, their dense 0-based place in pre-order.

    The models below a node, and itself, are those from ``pre`` to ``pre + size - 1``, so
    being an ancestor is a test of an interval. Siblings stand in the order of their names.
    """
    sided = ranked(trees.nodes, [F.col("to").asc_nulls_first(), F.col("node")], [], "_rank")
    sided = sided.withColumn("_block", F.floor(F.col("_rank") / BLOCK_ROWS))
    summed = running_total(sided, [], "_block", ["_rank"], F.col("size"), "_sum").withColumn("_before", F.col("_sum") - F.col("size"))
    summed = materialize(summed, "siblings")
    base = summed.groupBy(F.col("to").alias("_to")).agg(F.min("_before").alias("_base"))
    # Behind its parent and the families of the siblings before it.
    aside = F.col("_before") - F.col("_base") + F.col("to").isNotNull().cast("bigint")
    place = summed.join(_by_shuffle(base), F.col("to").eqNullSafe(F.col("_to"))).select("node", aside.alias("pre"))
    place = materialize(place, "places")
    for jump in trees.jumps:
        ahead = place.select(F.col("node").alias("jump"), F.col("pre").alias("_pre"))
        moved = place.join(_by_shuffle(jump), "node", "left").join(_by_shuffle(ahead), "jump", "left")
        place = materialize(moved.select("node", (F.col("pre") + F.coalesce("_pre", F.lit(0))).alias("pre")), "places")
    return materialize(trees.nodes.join(_by_shuffle(place), "node"), "labelled")


def _reach(uses: DataFrame) -> DataFrame:
    """``key, lo, hi``: the intervals of ``uses`` that no other of the same key contains.

    Intervals of a forest are nested or apart, so one is outermost if it begins behind the
    end of all that begin before it. A key's intervals are worked on in blocks.
    """
    spans = uses.distinct().groupBy("key", "lo").agg(F.max("hi").alias("hi"))
    spans = materialize(spans.withColumn("_block", F.floor(F.col("lo") / BLOCK_ROWS)), "spans")
    ends = spans.groupBy("key", "_block").agg(F.max("hi").alias("_end"))
    along = W.partitionBy("key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("key", "_block", F.max("_end").over(along).alias("_end"))
    inside = W.partitionBy("key", "_block").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_seen", F.max("hi").over(inside)).join(ends, ["key", "_block"])
    before = F.greatest(F.coalesce("_seen", F.lit(0)), F.coalesce("_end", F.lit(0)))
    return spans.where(F.col("lo") >= before).select("key", "lo", "hi")


def _uses(models: DataFrame, trees: Forest, labels: DataFrame) -> DataFrame:
    """``dataset, lo, hi``: which places each use of a dataset reaches.

    All models that lead into a cycle walk round it, so what a model of a cycle uses reaches all of them.
    """
    named = models.where(F.col("dataset").isNotNull()).select(F.col("name").alias("node"), F.col("dataset.name").alias("dataset"))
    own = labels.join(_by_shuffle(named), "node").select("node", "dataset", "pre", "size")
    if trees.rings is not None:
        roots = labels.select(F.col("node").alias("root"), F.col("pre").alias("_pre"), F.col("size").alias("_size"))
        ring = trees.rings.join(_by_shuffle(roots), "root").select("node", "_pre", "_size")
        own = own.join(_by_shuffle(ring), "node", "left").select(
            "node", "dataset", F.coalesce("_pre", "pre").alias("pre"), F.coalesce("_size", "size").alias("size")
        )
    return own.select("dataset", F.col("pre").alias("lo"), (F.col("pre") + F.col("size")).alias("hi"))


def _memory_classes(used_memories: DataFrame) -> DataFrame:
    """``memory_id, key, datasets``: memories that the same datasets hold share a key."""
    held = used_memories.groupBy("memory_id").agg(F.sort_array(F.collect_set("dataset")).alias("datasets"))
    return held.select("memory_id", F.sha2(F.to_json("datasets"), 256).alias("key"), "datasets")


def _class_reach(classes: DataFrame, uses: DataFrame) -> DataFrame:
    each = classes.select("key", "datasets").dropDuplicates(["key"]).select("key", F.explode("datasets").alias("dataset"))
    return _reach(each.join(uses, "dataset").select("key", "lo", "hi"))


def _at_places(labels: DataFrame, weighted: DataFrame, out: str) -> DataFrame:
    """``node`` and the weights of all intervals of ``weighted(lo, hi, weight)`` around it."""
    ends = weighted.select(F.inline(F.array(
        F.struct(F.col("lo").alias("pre"), F.col("weight").alias("_step")),
        F.struct(F.col("hi").alias("pre"), (-F.col("weight")).alias("_step")),
    )))
    steps = ends.groupBy("pre").agg(F.sum("_step").alias("_step"))
    rows = labels.select("node", "pre").join(_by_shuffle(steps), "pre", "left").withColumn("_block", F.floor(F.col("pre") / BLOCK_ROWS))
    return running_total(rows, [], "_block", ["pre"], F.coalesce("_step", F.lit(0)), out).select("node", out)


def model_reach(models: DataFrame, used_memories: DataFrame, trees: Forest | None = None) -> DataFrame:
    """``start, memories, examples, nearest`` of every model that memories fed over the generations of its walk.

    How many memories and examples (a dataset that several generations share counts
    once), and the nearest generation that has any. No model meets its memories: what a
    dataset or a class of memories reaches is a few intervals of places, and steps at
    their ends are added up along all places.
    """
    trees = trees or forest(models)
    labels = labelled(trees)
    uses = materialize(_uses(models, trees, labels), "uses")
    classes = materialize(_memory_classes(used_memories), "memory-classes")
    size = classes.groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    memories = _at_places(labels, _class_reach(classes, uses).join(size, "key"), "memories")
    fed = used_memories.groupBy(F.col("dataset").alias("key")).agg(F.sum("examples").alias("weight"))
    fed = materialize(fed, "fed")
    reached = _reach(uses.select(F.col("dataset").alias("key"), "lo", "hi"))
    examples = _at_places(labels, reached.join(fed, "key"), "examples")
    named = models.where(F.col("dataset").isNotNull()).select(F.col("name").alias("node"), F.col("dataset.name").alias("key"))
    marks = materialize(named.join(fed, "key", "left_semi").select("node", F.lit(0).cast("bigint").alias("mark")), "fed-models")
    near = trees.nodes.join(_by_shuffle(_nearest(trees, marks).select("node", "away")), "node")
    nearest = F.col("away")
    if trees.rings is not None:
        round_ = trees.rings.join(_by_shuffle(marks), "node").groupBy("root").agg(F.min("back").alias("_back"))
        near = near.join(_by_shuffle(round_), "root", "left")
        nearest = F.coalesce("away", F.col("depth") + 1 + F.col("_back"))
    near = near.select("node", nearest.alias("nearest")).where(F.col("nearest").isNotNull())
    return near.join(_by_shuffle(memories), "node").join(_by_shuffle(examples), "node").select(
        F.col("node").alias("start"), "memories", "examples", "nearest"
    )


def memory_reach(models: DataFrame, used_memories: DataFrame, trees: Forest | None = None) -> DataFrame:
    """``memory_id, models, direct`` of every memory: how many models it reached, and how many by their own dataset."""
    trees = trees or forest(models)
    uses = materialize(_uses(models, trees, labelled(trees)), "uses")
    classes = materialize(_memory_classes(used_memories), "memory-classes")
    reached = _class_reach(classes, uses).groupBy("key").agg(F.sum(F.col("hi") - F.col("lo")).alias("models"))
    own = models.where(F.col("dataset").isNotNull()).groupBy(F.col("dataset.name").alias("dataset")).agg(F.count(F.lit(1)).alias("_n"))
    each = classes.select("key", "datasets").dropDuplicates(["key"]).select("key", F.explode("datasets").alias("dataset"))
    direct = each.join(own, "dataset").groupBy("key").agg(F.sum("_n").alias("direct"))
    return classes.join(reached, "key").join(direct, "key").select("memory_id", "models", "direct")


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionAll(table)
    return whole


def lineage_all(models: DataFrame, dataset_meta: DataFrame) -> DataFrame:
    """The annotated walk of every model: one row per start and generation."""
    return annotate(ancestry(models), models, dataset_meta)


def annotate(walk: DataFrame, models: DataFrame, dataset_meta: DataFrame) -> DataFrame:
    facts = resolve_dataset(models, dataset_meta).select(
        F.col("name").alias("model"),
        "base_model",
        "trainer_agent",
        "dataset",
        "dataset_examples",
        "dataset_memories",
        "dataset_missing",
        "dataset_hash_mismatch",
        "job_id",
        "created_at",
    )
    return walk.join(facts, "model")


def walk_from(models: DataFrame, name: str) -> DataFrame:
    """The walk of one model; unknown names are an error. No depth is too deep."""
    start = models.where(F.col("name") == name).select(F.col("name").alias("start"))
    if start.isEmpty():
        raise UnknownModel(f"no model {name!r}")
    return ancestry(models, start)


def lineage_of(models: DataFrame, dataset_meta: DataFrame, name: str) -> DataFrame:
    return annotate(walk_from(models, name), models, dataset_meta)


def incomplete(ends: DataFrame, models: DataFrame) -> DataFrame:
    """Per start the last generation and why the walk ended there, from ``chain_ends``.

    ``reason`` is NULL at a true root, else names the missing parent or the cycle.
    """
    parents = models.select(F.col("name").alias("last_model"), "parent")
    known = models.select(F.col("name").alias("parent"), F.lit(True).alias("_known"))
    parent, last = quoted(F.col("parent")), quoted(F.col("last_model"))
    return (
        ends.join(parents, "last_model")
        .join(known, "parent", "left")
        .select(
            "start",
            "last_generation",
            (F.col("last_generation") + 1).alias("entries"),
            # The sentences.
            F.when(F.col("parent").isNull(), F.lit(None).cast("string"))
            .when(
                F.col("_known").isNull(),
                F.concat(
                    F.lit("parent "), parent, F.lit(" of "), last,
                    F.lit(" is not in the registry"),
                ),
            )
            .otherwise(
                F.concat(
                    F.lit("parent cycle detected at "), parent,
                    F.lit(" — a record points back at an ancestor"),
                )
            )
            .alias("reason"),
        )
    )


def dataset_memories(examples: DataFrame) -> DataFrame:
    """``dataset, memory_id, examples``: reduced before any join."""
    return (
        examples.where(F.col("provenance.memory_id").isNotNull())
        .groupBy("dataset", F.col("provenance.memory_id").alias("memory_id"))
        .agg(F.count("*").alias("examples"))
    )


def model_to_memories(
    walk: DataFrame, models: DataFrame, used_memories: DataFrame
) -> DataFrame:
    """Which memories fed each start, over all generations of its walk.

    ``used_memories`` comes from ``dataset_memories``. A dataset that several
    generations share counts once.
    """
    datasets = models.where(F.col("dataset").isNotNull()).select(
        F.col("name").alias("model"), F.col("dataset.name").alias("dataset")
    )
    reached = (
        walk.join(datasets, "model")
        .groupBy("start", "dataset")
        .agg(F.min("generation").alias("generation"))
    )
    return (
        reached.join(used_memories, "dataset")
        .groupBy("start", "memory_id")
        .agg(
            F.min("generation").alias("nearest_generation"),
            F.sum("examples").alias("examples"),
        )
    )


def memory_impact(
    walk: DataFrame, models: DataFrame, used_memories: DataFrame
) -> DataFrame:
    """The reverse: every model a memory reached, directly or by inheritance."""
    return model_to_memories(walk, models, used_memories).select(
        "memory_id", F.col("start").alias("model"), "nearest_generation", "examples"
    )


def examples_to_memories(examples: DataFrame, memories: DataFrame) -> DataFrame:
    """Examples with the memory they come from; sizes decide the join strategy."""
    return examples.withColumn("memory_id", F.col("provenance.memory_id")).join(
        memories.withColumnRenamed("id", "memory_id"), "memory_id"
    )
