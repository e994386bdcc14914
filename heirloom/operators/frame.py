"""Template framing: the question half of an example, from headings or tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heirloom.config import FrameConfig
from heirloom.functions import text as t
from heirloom.operators.gate import is_routing_tag

# Tags that describe the record, not its subject.
BOOKKEEPING_TAGS = (
    "session-notes",
    "session",
    "notes",
    "summary",
    "completion-summary",
    "status",
    "update",
    "wip",
    "todo",
    "misc",
    "general",
    "project-state",
)
# Above these a heading reads as a statement.
MAX_PHRASE_CHARS = 40
MAX_PHRASE_WORDS = 4


def tidy(s: Column) -> Column:
    """Drop surrounding backticks, a leading ``12. `` and trailing colons."""
    bare = t.strip(F.btrim(t.strip(s), F.lit("`")))
    unnumbered = F.regexp_replace(bare, r"^[0-9]+\. ", "")
    return t.strip(F.rtrim(t.strip(unnumbered), F.lit(":")))


def is_statement(heading: Column) -> Column:
    return (
        (F.length(heading) > MAX_PHRASE_CHARS)
        | (t.word_count(heading) > MAX_PHRASE_WORDS)
        | heading.contains(", ")
    )


def is_topical(tag: Column) -> Column:
    """True for a tag someone could ask about."""
    return t.let(
        F.lower(t.strip(tag)),
        lambda x: (x != "")
        & ~is_routing_tag(x)
        & ~x.isin(*BOOKKEEPING_TAGS)
        & ~x.rlike(r"^[0-9/-]+\z"),
    )


def join_natural(items: Column) -> Column:
    """``a`` / ``a and b`` / ``a, b, and c``."""
    n = F.size(items)
    return (
        F.when(n <= 2, F.array_join(items, " and "))
        .otherwise(
            F.concat(
                F.array_join(F.slice(items, F.lit(1), n - 1), ", "),
                F.lit(", and "),
                F.element_at(items, -1),
            )
        )
    )


def from_tags(tags: Column, cfg: FrameConfig = FrameConfig()) -> Column:
    """A question from the first topical tags, NULL when there are none."""
    limit = cfg.max_tags or 3
    subjects = F.transform(F.slice(F.filter(tags, is_topical), 1, limit), tidy)
    ending = f" in {cfg.domain}?" if cfg.domain is not None else "?"
    return t.let(
        subjects,
        lambda s: F.when(
            F.size(s) > 0,
            F.concat(F.lit("What do you know about "), join_natural(s), F.lit(ending)),
        ),
    )


def from_headings(path: Column) -> Column:
    """A question from a non-empty heading path."""

    def ask(p: Column) -> Column:
        doc, leaf = F.element_at(p, 1), F.element_at(p, -1)
        return (
            F.when(
                F.size(p) == 1,
                F.when(is_statement(doc), F.concat(F.lit("Explain: "), doc)).otherwise(
                    F.concat(F.lit("Explain "), doc, F.lit("."))
                ),
            )
            .when(
                t.ascii_lower(leaf) == t.ascii_lower(doc),
                F.concat(F.lit("Explain "), doc, F.lit(".")),
            )
            .when(
                is_statement(leaf),
                F.concat(F.lit("In "), doc, F.lit(", explain: "), leaf),
            )
            .otherwise(
                F.concat(
                    F.lit("Explain "), leaf, F.lit(", in the context of "), doc, F.lit(".")
                )
            )
        )

    return t.let(F.transform(path, tidy), ask)


def instruction(path: Column, tags: Column, cfg: FrameConfig = FrameConfig()) -> Column:
    """The question for one chunk; NULL when nothing honest can frame it."""
    return F.when(F.size(path) > 0, from_headings(path)).otherwise(from_tags(tags, cfg))


def instruction_kind(path: Column) -> Column:
    """The framing strategy ``instruction`` uses for ``path``."""
    return F.when(F.size(path) > 0, F.lit("templated_heading")).otherwise(F.lit("templated_tag"))
