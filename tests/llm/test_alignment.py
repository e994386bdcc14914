import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heirloom.llm import alignment
from heirloom.session import materialize

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
A, B = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True
PAIR = alignment.load(A_PATH, B_PATH)
ALIGNER = alignment.Aligner(PAIR)
VALUE = alignment.byte_characters()


def spans(sizes):
    at, out = 0, []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def brute(text):
    """Ids by the libraries, groups by common ends, links by comparing all pairs of a group."""
    if not text or "▁" in text:
        return [], [], [], Counter()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw_a = [bytes(VALUE[c] for c in A.id_to_token(i)) for i in a]
    raw_b = [bytes([i - 3]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    assert b"".join(raw_a) == b"".join(raw_b) == b" " + text.encode()
    at_a, at_b = spans(map(len, raw_a)), spans(map(len, raw_b))
    common = sorted({y for _, y in at_a} & {y for _, y in at_b})
    groups, links, lo = [], Counter(), 0
    for hi in common:
        xs = [k for k, (x, y) in enumerate(at_a) if lo <= x and y <= hi]
        ys = [k for k, (x, y) in enumerate(at_b) if lo <= x and y <= hi]
        groups.append((",".join(str(a[k]) for k in xs), ",".join(str(b[k]) for k in ys)))
        for i in xs:
            for j in ys:
                if max(at_a[i][0], at_b[j][0]) < min(at_a[i][1], at_b[j][1]):
                    links[a[i], b[j]] += 1
        lo = hi
    return a, b, groups, links


TEXTS = [
    "The quick brown fox, unbelievably, doesn't jump.\n\nOver   the\tlazy dog...",
    "Éleère è aichan éonçé euxierê. Übergrößenträger 😀😀 日本語",
    "<|endoftext|> is a plain string here <s> </s> <0x0A>",
    "a",
    " ",
    "  \n \n\nx  \n",
    "https://example.com/a?b=c&d=12345678901234567890" * 5,
    "holds the mark ▁ itself",
]


def check_rows(got, rows):
    found = [brute(text) for _, text in rows]
    docs = Counter(link for _, _, _, links in found for link in links)
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    want = []
    for (doc_id, _), (a, b, groups, links) in zip(rows, found, strict=True):
        written = ";".join(f"{x}|{y}" for x, y in groups)
        best = sum(n for link, n in links.items() if docs[link] == most[link[0]])
        total = sum(n * docs[link] for link, n in links.items())
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        want.append((doc_id, len(a), len(b), len(groups), links.total(), best, total, digest))
    assert Counter(want) == Counter(map(tuple, got))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.data())
def test_align_against_sets(sizes, data):
    total = sum(sizes)
    x = sorted({total, *data.draw(st.lists(st.integers(1, total)))})
    y = sorted({total, *(e for e in x if data.draw(st.booleans())), *data.draw(st.lists(st.integers(1, total)))})
    x_last, y_last, of_x, of_y = alignment.align(x, y)
    assert [e for e, last in zip(x, x_last, strict=True) if last] == sorted({*x} & {*y})
    assert [e for e, last in zip(y, y_last, strict=True) if last] == sorted({*x} & {*y})
    want = {
        (i, j)
        for i in range(len(x))
        for j in range(len(y))
        if max([0, *x][i], [0, *y][j]) < min(x[i], y[j])
    }
    assert sorted(zip(of_x.tolist(), of_y.tolist(), strict=True)) == sorted(want)


def test_long_one_to_one_stretches():
    x = list(range(1, 100_001))
    y = [e for e in x if e not in (70_000, 70_001)]
    x_last, y_last, of_x, _ = alignment.align(x, y)
    assert sum(x_last) == sum(y_last) == len(y) and len(of_x) == len(x)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abet's 12 \n\t\r.é日😀  "), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_first_ids_are_the_librarys(text):
    assert ALIGNER.first_ids(text) == A.encode(text, add_special_tokens=False).ids


def test_both_libraries_part_and_merge_all_characters_alike():
    assert ALIGNER.quick is not None
    step, chars = 4000, [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(chars), step):
        for text in (" ".join(chars[lo : lo + step]), "a".join(chars[lo : lo + step]), "1".join(chars[lo : lo + step])):
            assert ALIGNER.quick.encode_ordinary(text) == A.encode(text, add_special_tokens=False).ids


def test_long_parts():
    for text in ("ab" * 50_000, " " * 50_000 + "x", "\n" * 3000, "!?" * 3000, "é" * 3000):
        assert ALIGNER.first_ids(text) == A.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("few", [alignment.FEW, 0])
def test_counts_against_brute_force(spark, few):
    rng = random.Random(3)
    words = "the of and tion unre walked Xylo é 12 ' don't 😀 \n".split(" ")
    rows = [(k, text) for k, text in enumerate(TEXTS)]
    rows += [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(40)]
    rows += [(7, "twice the same"), (7, "twice the same"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    docs = docs.selectExpr("*", "1 AS n_a", "2 AS links", "3 AS llm_row")
    found = alignment.alignments(docs, PAIR).selectExpr("*", "IF(n_a = 0, '', sha2(groups, 256)) AS digest")
    counted = alignment.with_pair_counts(materialize(found.drop("groups"), "test"), few)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest"]
    check_rows(counted.select(*names).collect(), rows)


def test_groups_are_written_as_text(spark):
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id BIGINT, text STRING")
    got = alignment.alignments(docs, PAIR).first()
    assert got.groups == ";".join(f"{x}|{y}" for x, y in brute(TEXTS[0])[2])


def test_empty_table_and_long_texts(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    found = materialize(alignment.alignments(docs, PAIR), "test")
    assert alignment.with_pair_counts(found).count() == 0
    text = "some words\n" * 60_000
    docs = spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")
    got = alignment.alignments(docs, PAIR).first()
    assert got.n_a == len(A.encode(" " + text, add_special_tokens=False).ids) and got.n_b == len(B.encode(text))


def test_query(spark):
    from heirloom.llm.queries import op11_tokenizer_alignment, table

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect() if len(r.text or "") < 4000]
    got = op11_tokenizer_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    sizes = {r.doc_id: r for r in got.collect()}
    for doc_id, text in rows[:60]:
        a, b, groups, links = brute(text)
        r = sizes[doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), links.total())
        written = ";".join(f"{x}|{y}" for x, y in groups)
        assert r.groups_sha256 == (hashlib.sha256(written.encode()).hexdigest() if a else "")
