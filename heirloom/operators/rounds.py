"""Rounds of a session: splitting, licence class, verdict and rendering.

Messages carry ``session_id``, ``file_path`` and an order ``(block, pos)``:
``block`` is a stretch of a session that is small enough for one task (a file
split, or a range of sequence numbers).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heirloom.config import USED, HarvestConfig
from heirloom.functions import secrets
from heirloom.functions import text as t
from heirloom.operators import examples as ex
from heirloom.operators import gate
from heirloom.operators.messages import starts_round
from heirloom.session import materialize

#: So many places of openers (a block counts as eight) are sent to all tasks.
FEW_OPENERS = 1 << 22
#: A block has fewer openers than two to the power of this.
BLOCK_BITS = 24

# Model name prefixes whose reasoning is hidden and closed.
CLOSED_PREFIXES = ("claude-", "gpt-", "o1-", "o3-", "o4-", "grok-", "gemini-")
# Marks that open a rendered tool call, tool result and tool error.
TOOL_CALL, TOOL_RESULT, TOOL_ERROR = "🔧", "↳", "⚠"

SESSION = ["file_path", "session_id"]
ROUND = [*SESSION, "turn_index"]


def _at_or_before(places: Column, at: Column) -> Column:
    """How many of the sorted ``places`` are not behind ``at``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(BLOCK_BITS - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda n, step: F.when(F.get(places, n + step - 1) <= at, n + step).otherwise(n)
    )


def with_turns(messages: DataFrame, few: int = FEW_OPENERS) -> DataFrame:
    """Add the 0-based ``turn_index`` of the round each message belongs to.

    A round begins at every opener but the first message, which is in round 0
    whether it opens or not. Only where rounds begin is gathered: a sorted list for
    each block, in which a message finds its place. While these lists are short in all
    they are sent to all tasks and no message moves.
    """
    opens = starts_round(F.col("role"), F.col("blocks"))
    narrow = messages.select(*SESSION, "block", "pos", F.coalesce(opens, F.lit(False)).alias("_opens"))
    lists = narrow.groupBy(*SESSION, "block").agg(
        F.sort_array(F.collect_list(F.when(F.col("_opens"), F.col("pos")))).alias("_openers"),
        F.min_by("_opens", "pos").alias("_first"),
    )
    along = W.partitionBy(*SESSION).orderBy("block")
    before = F.coalesce(F.sum(F.size("_openers")).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = F.first("_first").over(along.rowsBetween(W.unboundedPreceding, 0))
    lists = lists.select(
        *[F.col(c).alias(f"_{c}") for c in (*SESSION, "block")], "_openers", (before - first.cast("int")).alias("_before")
    )
    seen = Observation(f"openers-{uuid.uuid4().hex}")
    size = F.sum(F.size("_openers") + 8).alias("n")
    lists = materialize(lists.observe(seen, size), "openers")
    small = F.broadcast(lists) if (seen.get["n"] or 0) <= few else lists
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*SESSION, "block")]
    turn = F.col("_before") + _at_or_before(F.col("_openers"), F.col("pos"))
    return messages.join(small, same).select(*messages.columns, turn.cast("int").alias("turn_index"))


def message_parts(messages: DataFrame) -> DataFrame:
    """Reduce each message to what its round needs; all row-local."""
    blocks = F.col("blocks")
    is_user = F.col("role") == "user"
    texts = F.transform(
        F.filter(blocks, lambda b: F.coalesce(t.not_blank(b["text"]), F.lit(False))),
        lambda b: b["text"],
    )

    def rendered(b: Column) -> Column:
        said = (
            F.when(
                (b["type"] == "thinking") & t.not_blank(b["thinking"]),
                F.concat(F.lit("Thinking:\n"), t.strip(b["thinking"])),
            )
            .when((b["type"] == "text") & t.not_blank(b["text"]), b["text"])
            .when(
                b["type"] == "tool_use",
                F.concat(
                    F.lit(f"{TOOL_CALL} `"), b["name"], F.lit("`("), b["input_json"], F.lit(")")
                ),
            )
        )
        returned = F.when(
            b["type"] == "tool_result",
            F.concat(
                F.when(b["is_error"], f"{TOOL_ERROR} ").otherwise(f"{TOOL_RESULT} "),
                b["result_text"],
            ),
        )
        return F.struct(
            (b["type"] == "thinking").alias("is_thinking"),
            F.when(is_user, returned).otherwise(said).alias("s"),
        )

    return messages.select(
        *ROUND,
        "block",
        "pos",
        F.when(is_user, texts).otherwise(F.array().cast("array<string>")).alias("user_parts"),
        F.filter(F.transform(blocks, rendered), lambda p: p["s"].isNotNull()).alias("said_parts"),
        F.exists(blocks, lambda b: b["type"] == "image").alias("has_image"),
        F.exists(
            blocks,
            lambda b: F.coalesce(t.not_blank(b["signature"]), F.lit(False)),
        ).alias("signed"),
        F.array_max(F.transform(blocks, lambda b: F.length(b["result_text"]))).alias(
            "longest_result"
        ),
    )


def round_facts(parts: DataFrame) -> DataFrame:
    """Per round the facts that decide most verdicts, without gathering its text.

    Only scalars are aggregated, so they combine before the shuffle: a round of
    any length costs one small row per task.
    """
    order = F.struct("block", "pos")
    has_text = F.size("user_parts") > 0
    return parts.groupBy(*ROUND).agg(
        F.bool_or(has_text).alias("has_user_text"),
        F.min_by(
            F.when(has_text, t.first_line(F.get("user_parts", F.lit(0)))),
            F.when(has_text, order),
        ).alias("first_line"),
        F.bool_or(F.exists("user_parts", gate.direct_address)).alias("addressed"),
        F.bool_or("has_image").alias("has_image"),
        F.bool_or("signed").alias("signed"),
        F.max("longest_result").alias("longest_result"),
        F.count("*").alias("n_messages"),
    )


def early_verdict(cfg: HarvestConfig = HarvestConfig()) -> Column:
    """The verdict as far as ``round_facts`` decides it, NULL for the rest."""
    opener = t.starts_with_any(F.lower("first_line"), gate.GREETING_OPENERS)
    return (
        F.when(~F.col("has_user_text") & F.col("has_image"), "image_only")
        .when(~F.col("has_user_text"), "empty_assistant")
        .when(opener | F.col("addressed"), "chatter")
        .when(F.col("longest_result") > cfg.max_tool_result_chars, "tool_result_too_long")
    )


def classify_license(
    model: Column, signed: Column, cfg: HarvestConfig = HarvestConfig()
) -> Column:
    """An allowlist: reasoning is open only for a model that is named as open."""
    name = t.ascii_lower(t.strip(model))
    opened = tuple(t_.lower() for t_ in cfg.open_prefixes)
    return (
        F.when(signed, "closed_hidden")
        .when(t.starts_with_any(name, CLOSED_PREFIXES), "closed_hidden")
        .when(t.starts_with_any(name, opened), "open_reasoning")
        .otherwise("answer_only")
    )


def stamp_sessions(rounds: DataFrame, stamps: DataFrame | None) -> DataFrame:
    """Attach agent, model and stamped class by session id; unstamped rows stay.

    Whether the stamps are broadcast is left to their measured size.
    """
    if stamps is None:
        return (
            rounds.withColumn("agent_id", F.lit(None).cast("string"))
            .withColumn("model", F.lit(None).cast("string"))
            .withColumn("stamped_class", F.lit(None).cast("string"))
        )
    return rounds.join(stamps, "session_id", "left")


def with_license(facts: DataFrame, cfg: HarvestConfig = HarvestConfig()) -> DataFrame:
    """Add ``license_class``; a stamped class overrides what would be concluded."""
    return facts.withColumn(
        "license_class",
        F.coalesce("stamped_class", classify_license(F.col("model"), F.col("signed"), cfg)),
    )


def render_rounds(parts: DataFrame, open_rounds: DataFrame, cfg: HarvestConfig) -> DataFrame:
    """Gather the text of the rounds that are still in play and finish the verdict."""
    order = F.struct(
        F.col("block"), F.col("pos"), F.col("user_parts"), F.col("said_parts")
    )
    carried = ["license_class", "agent_id", "model", "signed", "n_messages"]
    gathered = (
        parts.select(*ROUND, "block", "pos", "user_parts", "said_parts")
        .join(open_rounds.select(*ROUND, *carried), ROUND)
        .groupBy(*ROUND, *carried)
        .agg(F.sort_array(F.collect_list(order)).alias("ms"))
    )
    said = F.flatten(F.transform("ms", lambda m: m["said_parts"]))
    kept = F.filter(
        said, lambda p: ~p["is_thinking"] | (F.col("license_class") == "open_reasoning")
    )
    texts = (
        gathered.withColumn(
            "user_text", F.array_join(F.flatten(F.transform("ms", lambda m: m["user_parts"])), "\n")
        )
        .withColumn("assistant", F.array_join(F.transform(kept, lambda p: p["s"]), "\n\n"))
        .drop("ms")
    )
    scan = F.concat(F.col("user_text"), F.lit("\n"), F.col("assistant"))
    verdict = F.when(t.is_blank(F.col("assistant")), "empty_assistant").when(
        secrets.looks_like_secret(scan, cfg.min_token_hex), "secret"
    )
    return texts.withColumn("verdict", verdict.otherwise(USED))


OUTCOME = [
    "file_path",
    "session_id",
    "turn_index",
    "line_pos",
    "verdict",
    "license_class",
    "agent_id",
    "model",
    "signed",
    "n_messages",
    "user_text",
    "assistant",
]


def assess_rounds(
    numbered: DataFrame, stamps: DataFrame | None, cfg: HarvestConfig = HarvestConfig()
) -> DataFrame:
    """One row per round with its verdict, and its text where it is used."""
    parts = message_parts(numbered)
    facts = with_license(stamp_sessions(round_facts(parts), stamps), cfg).withColumn(
        "verdict", early_verdict(cfg)
    )
    if cfg.drop_closed:
        facts = facts.withColumn(
            "verdict",
            F.coalesce(
                "verdict", F.when(F.col("license_class") == "closed_hidden", "closed_license")
            ),
        )
    settled = facts.where(F.col("verdict").isNotNull())
    rendered = render_rounds(parts, facts.where(F.col("verdict").isNull()), cfg)
    shape = [F.col(c) if c != "line_pos" else F.lit(None).cast("bigint").alias(c) for c in OUTCOME]
    none = F.lit(None).cast("string")
    return (
        settled.withColumn("user_text", none)
        .withColumn("assistant", none)
        .select(*shape)
        .unionByName(
            rendered.withColumn(
                "user_text", F.when(F.col("verdict") == USED, F.col("user_text"))
            )
            .withColumn("assistant", F.when(F.col("verdict") == USED, F.col("assistant")))
            .select(*shape)
        )
    )


def rejected_rows(rows: DataFrame, verdict: str | Column) -> DataFrame:
    """Skipped files or unreadable lines in the shape of an outcome."""
    reason = F.lit(verdict) if isinstance(verdict, str) else verdict
    given = {"file_path", "session_id"} | ({"line_pos"} & set(rows.columns))
    types = {
        "turn_index": "int",
        "line_pos": "bigint",
        "signed": "boolean",
        "n_messages": "bigint",
    }
    return rows.withColumn("verdict", reason).select(
        *[
            F.col(c)
            if c in given or c == "verdict"
            else F.lit(None).cast(types.get(c, "string")).alias(c)
            for c in OUTCOME
        ]
    )


def examples(outcomes: DataFrame, node_id: str | Column) -> DataFrame:
    """Examples of the used rounds, keyed by file and turn."""
    node = F.lit(node_id) if isinstance(node_id, str) else node_id
    used = outcomes.where(F.col("verdict") == USED)
    return used.select(
        F.struct(
            F.split("file_path", "/").alias("file"), F.col("turn_index").alias("ix")
        ).alias("example_key"),
        ex.messages(F.col("user_text"), F.col("assistant")).alias("messages"),
        ex.provenance(
            "session_turn",
            node_id=node,
            session_id=F.col("session_id"),
            turn_index=F.col("turn_index"),
            agent_id=F.col("agent_id"),
            license_class=F.col("license_class"),
            model=F.col("model"),
        ).alias("provenance"),
        F.lit("lived_turn").alias("instruction_kind"),
    )
