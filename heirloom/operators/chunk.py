"""Sectioning of a memory into teachable chunks.

The whole computation stays inside one row: a document is an array of lines and
a chunk an element of an array. Nothing is exploded before the chunks are final,
so sectioning needs no shuffle, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirloom.config import ChunkConfig
from heirloom.functions import text as t
from heirloom.functions.memo import per_application

CHUNK_TYPE = "STRUCT<heading_path: ARRAY<STRING>, body: STRING>"
DASH = " — "


def heading_level(line: Column) -> Column:
    """Number of leading hashes of a line that already lost its indentation."""
    return F.length(F.regexp_extract(line, "^(#*)", 1))


def heading_text(line: Column, level: Column) -> Column:
    rest = t.strip(F.substring(line, level + 1, F.length(line)))
    return t.strip(F.rtrim(rest, F.lit(":")))


def is_heading(line: Column) -> Column:
    """``##`` to ``######`` followed by some text."""
    return t.let(
        t.strip_start(line),
        lambda s: s.startswith("##")
        & (heading_level(s) <= 6)
        & (heading_text(s, heading_level(s)) != ""),
    )


def looks_like_label(s: Column) -> Column:
    return t.let(
        t.strip(s),
        lambda x: (x != "")
        & ~x.endswith(".")
        & (t.word_count(x) <= 8)
        & (F.length(x) <= 50),
    )


def is_labelled_banner(line: Column) -> Column:
    """A line that names its document by a keyword or by ``LABEL — rest``."""
    keyword = line.rlike("(?i)^(?:PROCEDURE[ :—]|ARCHITECTURE DECISION)")
    label = F.substring_index(line, DASH, 1)
    dashed = (
        line.contains(DASH)
        & F.octet_length(label).between(1, 50)
        & looks_like_label(label)
    )
    return keyword | dashed


def document_title(trimmed: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """The first line of trimmed content where it reads like a title, else NULL."""

    def decide(first: Column) -> Column:
        bare = t.strip(F.ltrim(first, F.lit("#")))
        short = F.length(bare) <= cfg.max_title
        plain = first.startswith("#") | ~bare.endswith(".")
        return F.when(
            ~is_heading(first) & (bare != "") & (is_labelled_banner(bare) | (short & plain)),
            bare,
        )

    return t.let(t.first_line(trimmed), decide)


def headings(lines: Column) -> Column:
    """Headings of an array of lines, as ``{pos, level, text}`` with 0-based ``pos``."""
    marked = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("pos"), t.strip_start(x).alias("s"))),
        lambda x: x["s"].startswith("##"),
    )
    levelled = F.transform(
        marked,
        lambda x: F.struct(
            x["pos"].alias("pos"), heading_level(x["s"]).alias("level"), x["s"].alias("s")
        ),
    )
    texts = F.transform(
        levelled,
        lambda x: F.struct(
            x["pos"].alias("pos"),
            x["level"].alias("level"),
            heading_text(x["s"], x["level"]).alias("text"),
        ),
    )
    return F.filter(texts, lambda x: (x["level"] <= 6) & (x["text"] != ""))


#: Elements of an array that a fold takes in one go.
BLOCK = 256


def _blocks(size: Column) -> Column:
    """The numbers of the blocks of an array: none for an empty one."""
    return F.when(size == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
    )


def heading_trails(heads: Column) -> Column:
    """For each heading the live ancestors and itself, outermost first.

    Element 0 is the empty trail that holds before the first heading. A block of headings
    is folded into a short array, so that the long one is copied once a block.
    """
    start = F.expr("cast(array(array()) as array<array<struct<level: int, text: string>>>)")

    def step(trails: Column, h: Column) -> Column:
        above = F.filter(F.element_at(trails, -1), lambda x: x["level"] < h["level"])
        own = F.array(F.struct(h["level"].alias("level"), h["text"].alias("text")))
        return F.concat(trails, F.array(F.concat(above, own)))

    def block(hs: Column):
        return lambda trails, k: F.aggregate(
            F.slice(hs, k * BLOCK + 1, F.lit(BLOCK)),
            F.slice(trails, F.lit(-1), F.lit(1)),
            step,
            lambda more: F.concat(trails, F.slice(more, F.lit(2), F.size(more) - 1)),
        )

    return t.let(heads, lambda hs: F.aggregate(_blocks(F.size(hs)), start, block(hs)))


def sections(title: Column, lines: Column, heads: Column) -> Column:
    """Non-empty text between headings, each under its trail.

    Lines, headings and trails are bound once: inside the per-section lambda the
    optimizer would otherwise be free to compute them again for every section.
    """

    def cut(ls: Column, hs: Column, trails: Column) -> Column:
        def section(k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(hs, k - 1)["pos"] + 1)
            end = F.when(k == F.size(hs), F.size(ls)).otherwise(F.get(hs, k)["pos"])
            body = t.strip(F.array_join(F.slice(ls, begin + 1, end - begin), "\n"))
            path = F.concat(
                F.when(title.isNull(), F.array().cast("array<string>")).otherwise(F.array(title)),
                F.transform(F.get(trails, k), lambda x: x["text"]),
            )
            return F.struct(path.alias("heading_path"), body.alias("body"))

        every = F.transform(F.sequence(F.lit(0), F.size(hs)), section)
        return F.filter(every, lambda s: s["body"] != "")

    return t.let(
        lines,
        lambda ls: t.let(
            heads, lambda hs: t.let(heading_trails(hs), lambda trails: cut(ls, hs, trails))
        ),
    )


def _merge_starts(lengths: Column, cfg: ChunkConfig) -> Column:
    """The sections that begin a merged one, by the lengths of all.

    Only numbers are folded: where merged sections begin, and how long the one is that is
    still too short (-1: none). A block is folded into a short array first.
    """
    none = F.lit(-1).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["held"] < 0
        grown = F.when(fresh, x["n"]).otherwise(acc["held"] + 2 + x["n"])
        return F.struct(
            F.when(fresh, F.concat(acc["starts"], F.array(x["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(grown < cfg.min_section, grown).otherwise(none).alias("held"),
        )

    def block(acc: Column, k: Column, ls: Column) -> Column:
        return F.aggregate(
            F.slice(ls, k * BLOCK + 1, F.lit(BLOCK)),
            F.struct(F.array().cast("array<int>").alias("starts"), acc["held"].alias("held")),
            step,
            lambda more: F.struct(
                F.concat(acc["starts"], more["starts"]).alias("starts"), more["held"].alias("held")
            ),
        )

    start = F.struct(F.array().cast("array<int>").alias("starts"), none.alias("held"))
    sized = F.transform(lengths, lambda n, i: F.struct(i.alias("i"), n.cast("bigint").alias("n")))
    return t.let(
        sized,
        lambda ls: F.aggregate(
            _blocks(F.size(ls)), start, lambda acc, k: block(acc, k, ls), lambda acc: acc["starts"]
        ),
    )


def merge_short_forward(secs: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """Carry a short section into the next one, which then takes the earlier path.

    Where merged sections begin is found from lengths; each body is then copied once.
    """

    def merged(ss: Column, starts: Column) -> Column:
        def one(a: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(ss))
            bodies = F.transform(F.slice(ss, a + 1, end - a), lambda s: s["body"])
            return F.struct(
                F.get(ss, a)["heading_path"].alias("heading_path"),
                F.array_join(bodies, "\n\n").alias("body"),
            )

        return F.transform(starts, one)

    return t.let(
        secs,
        lambda ss: t.let(
            _merge_starts(F.transform(ss, lambda s: F.length(s["body"])), cfg),
            lambda starts: merged(ss, starts),
        ),
    )


def pack_paragraphs(body: Column, max_chunk: int) -> Column:
    """Greedy packing of blank-line paragraphs, by bytes, into at most ``max_chunk``.

    Only where a piece starts is folded; the pieces are then cut with slices, so
    the text is copied once however many paragraphs there are.
    """

    def cut(paras: Column) -> Column:
        sized = F.transform(
            paras, lambda p, i: F.struct(i.alias("i"), F.octet_length(p).alias("n"))
        )
        start = F.expr("named_struct('starts', array(0), 'held', 0)")

        def step(acc: Column, x: Column) -> Column:
            grown = acc["held"] + 2 + x["n"]
            return (
                F.when(
                    acc["held"] == 0,
                    F.struct(acc["starts"].alias("starts"), x["n"].alias("held")),
                )
                .when(
                    grown > max_chunk,
                    F.struct(
                        F.concat(acc["starts"], F.array(x["i"])).alias("starts"),
                        x["n"].alias("held"),
                    ),
                )
                .otherwise(F.struct(acc["starts"].alias("starts"), grown.alias("held")))
            )

        starts = F.aggregate(sized, start, step, lambda acc: acc["starts"])

        def pieces(s: Column) -> Column:
            each = F.transform(
                s,
                lambda a, k: t.strip(
                    F.array_join(
                        F.slice(
                            paras,
                            a + 1,
                            F.coalesce(F.get(s, k + 1), F.size(paras)) - a,
                        ),
                        "\n\n",
                    )
                ),
            )
            # A blank last piece is dropped; a blank piece in the middle is not.
            return F.filter(each, lambda p, k: (p != "") | (k < F.size(s) - 1))

        return t.let(starts, pieces)

    return t.let(F.split(body, "\n\n"), cut)


def split_oversized(chunks: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """Replace every chunk over the limit by its packed pieces."""
    return F.flatten(
        F.transform(
            chunks,
            lambda c: F.when(F.length(c["body"]) <= cfg.max_chunk, F.array(c)).otherwise(
                F.transform(
                    pack_paragraphs(c["body"], cfg.max_chunk),
                    lambda p: F.struct(
                        c["heading_path"].alias("heading_path"), p.alias("body")
                    ),
                )
            ),
        )
    )


OUTLINE_COLUMNS = ("_text", "_title", "_lines", "_heads")


@per_application
def _outline(content: str, cfg: ChunkConfig) -> dict[str, Column]:
    """The outline columns in the order in which they build on each other."""
    body_lines = t.let(
        t.lines(F.col("_text")),
        lambda ls: F.when(F.col("_title").isNull(), ls).otherwise(
            F.slice(ls, F.lit(2), F.size(ls))
        ),
    )
    return {
        "_text": F.nullif(t.strip(F.col(content)), F.lit("")),
        "_title": document_title(F.col("_text"), cfg),
        "_lines": F.when(F.col("_text").contains("##"), body_lines),
        "_heads": headings(F.col("_lines")),
    }


@per_application
def _chunks(cfg: ChunkConfig) -> dict[str, Column]:
    """From the outline to units, and from units to chunks."""
    title = F.col("_title")
    whole = F.array(
        F.struct(
            F.when(title.isNull(), F.array().cast("array<string>"))
            .otherwise(F.array(title))
            .alias("heading_path"),
            F.col("_text").alias("body"),
        )
    )
    sectioned = merge_short_forward(sections(title, F.col("_lines"), F.col("_heads")), cfg)
    return {
        "_units": F.when(F.col("_text").isNull(), F.lit(None))
        .when(F.coalesce(F.size("_heads"), F.lit(0)) > 0, sectioned)
        .otherwise(whole),
        "_chunks": split_oversized(F.col("_units"), cfg),
    }


def with_outline(df: DataFrame, content: str, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Add the intermediate columns of sectioning for the text column ``content``.

    ``_text`` trimmed text (NULL when blank), ``_title``, ``_lines`` (without a
    lifted title line) and ``_heads``. Text without ``##`` is never split into
    lines.
    """
    for name, column in _outline(content, cfg).items():
        df = df.withColumn(name, column)
    return df


def with_chunks(
    df: DataFrame, content: str = "content", cfg: ChunkConfig = ChunkConfig(), out: str = "chunks"
) -> DataFrame:
    """Add ``out``: the chunks of ``content`` as an array. NULL text gives NULL."""
    df = with_outline(df, content, cfg)
    for name, column in _chunks(cfg).items():
        df = df.withColumn(name, column)
    return df.drop(*OUTLINE_COLUMNS, "_units").withColumnRenamed("_chunks", out)


def explode_chunks(df: DataFrame, *keep: str, chunks: str = "chunks") -> DataFrame:
    """One row per chunk: the kept columns, ``chunk_ix``, ``heading_path``, ``body``."""
    # Outer, so that no filter on the array is derived and pushed below its making.
    return (
        df.select(*keep, F.posexplode_outer(chunks).alias("chunk_ix", "_c"))
        .where(F.col("chunk_ix").isNotNull())
        .select(*keep, "chunk_ix", F.col("_c.heading_path"), F.col("_c.body"))
    )
