import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from buslens.llm.queries import vocabulary
from buslens.llm.sentencepiece_codec import PieceModel, decode_documents, encode_documents, round_trip
from tests.llm.helpers import DOCS, ODD_DOCUMENTS, ordered, with_clashes

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


def same(model, library, texts):
    ids, lengths = model.encode(texts)
    want = library.encode(texts)
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert [t.decode() for t in model.decode(ids, lengths)] == [library.decode(w) for w in want]


def test_odd_texts(model, library):
    same(model, library, ["", " ", "   ", "\n", "▁", "▁▁a", " a  b   c    d ", "\x00\t", "don't 1,234.5 http://x.y/?a=b", "    return x;\n}\n"])


def test_random_texts(model, library):
    random.seed(3)
    alphabet = "   \n\tabcdething.,!?'-_=/*#(){}0123éüß中文😀ｆ́▁\x00İ"
    texts = ["".join(random.choices(alphabet, k=random.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(random.choices("ethaniors t", k=random.randint(1, 80))) for _ in range(2000)]
    same(model, library, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=80), max_size=4))
def test_any_text(texts):
    same(PieceModel.__dict__.get("_shared") or _shared(), _library(), texts)


_cache = {}


def _shared():
    return _cache.setdefault("model", PieceModel(PATH))


def _library():
    return _cache.setdefault("library", sentencepiece.SentencePieceProcessor(model_file=PATH))


def test_backtracking_agrees_with_merging(model):
    for word in ("▁antidisestablishmentarianism", "▁aaaaaaaaab", "ththththe", "▁internationalization"):
        assert model.pieces(word) == model._merged(word)


def test_table_stays_bounded(library):
    small = PieceModel(PATH)
    small.table.limit = 40
    texts = [f"word{k} the other {k % 7}" for k in range(300)]
    for at in range(0, 300, 10):
        same(small, library, texts[at : at + 10])
    assert len(small.table.code) <= 60


def test_documents(spark, library):
    docs = with_clashes(spark.createDataFrame(ODD_DOCUMENTS, DOCS))
    want = []
    for doc, text in ODD_DOCUMENTS:
        ids = library.encode(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert ordered(round_trip(docs, PATH).collect()) == ordered(want)
    back = decode_documents(encode_documents(docs, PATH), PATH)
    assert ordered(back.collect()) == ordered((d, t or "") for d, t in ODD_DOCUMENTS)


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], DOCS), PATH).collect() == []
