import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from heirloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODER = pieces.Coder(pieces.load(PATH))
CHARS = "abehinost    \n\t.,-=éèß日本語Ｗﬁ½😀▁\x00�<0x1A>​ "


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(CHARS), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_and_texts_are_the_librarys(text):
    ids = CODER.encode(text)
    assert ids == LIBRARY.encode(text)
    assert CODER.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 258), st.sampled_from([259, 28705])), max_size=12))
def test_any_ids_decode_as_by_the_library(ids):
    assert CODER.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("part", [" ", "a", "ab", "-", "=", " a", "  \n", "the", "日", "😀", "▁"])
def test_runs(part):
    for n in range(1, 80):
        assert CODER.encode(part * n) == LIBRARY.encode(part * n)


def test_compatible_is_what_the_library_leaves_apart():
    rng = random.Random(5)
    for _ in range(3000):
        x, y = rng.randrange(259, 32000), rng.randrange(259, 32000)
        pair = [CODER.token[x], CODER.token[y]]
        parts = list("".join(pair))
        while True:
            ranks = [CODER.rank.get(p + q, CODER.never) for p, q in zip(parts, parts[1:], strict=False)]
            if min(ranks, default=CODER.never) == CODER.never:
                break
            at = ranks.index(min(ranks))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert CODER.compatible(x, y) == (parts == pair)


def test_long_texts_and_forgetting(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("etaoin shrdlu\n") for _ in range(300_000))
    want = LIBRARY.encode(text)
    monkeypatch.setattr(pieces, "REMEMBERED", 200)
    monkeypatch.setattr(pieces, "WINDOW", 1000)
    coder = pieces.Coder(pieces.load(PATH))
    assert coder.encode(text) == want and len(coder.known) <= 200
    stretch = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    assert coder.encode(stretch) == LIBRARY.encode(stretch)


def test_rows(spark):
    rows = [(1, "two  words", 5), (1, "two  words", 6), (None, None, 7), (3, "", 8), (4, "é\x00▁", 9)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids INT").repartition(2)
    words = pieces.load(PATH)
    got = pieces.decode(pieces.encode(docs, words), words)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    for r in got.collect():
        assert r.ids == LIBRARY.encode(r.text or "") and r.decoded == LIBRARY.decode(r.ids)
    kept = pieces.encode(docs, words, into="tokens")
    assert sorted(r.ids for r in kept.collect()) == [5, 6, 7, 8, 9]
    assert pieces.encode(docs.limit(0), words).count() == 0
    none = spark.createDataFrame([(None,)], "ids ARRAY<INT>")
    assert pieces.decode(none, words).first().decoded == ""


def test_models_that_change_texts_are_refused(monkeypatch):
    class Folding(sentencepiece.SentencePieceProcessor):
        def encode(self, text):
            return super().encode(text.lower())

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="keep texts as they are"):
        pieces.load(PATH)


def test_query(spark):
    from heirloom.llm.queries import op13_sentencepiece, table

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    got = op13_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
