import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from buslens.llm.byte_bpe import SIDE_BY_SIDE, SLAB, ByteBPE, ByteTree, decode_documents, encode_documents, round_trip
from buslens.llm.queries import vocabulary
from tests.llm.helpers import DOCS, ODD_DOCUMENTS, ordered, with_clashes

PATH, PATTERN = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(PATH, PATTERN)


def odd_texts():
    pick = random.Random(7)
    letters = "ab 's'tre  \n\t12é中😀՘\U00011de0\x1c\xa0.,!#"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 150))) for _ in range(400)]
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return [*texts, "", "x" * 5000, "ab" * 3333, " " * 999 + "a", "<|endoftext|>", everything, "word " * (SLAB // 3)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_equals_library(name):
    own, other, texts = ByteBPE(vocabulary(name), PATTERN), library(vocabulary(name)), odd_texts()
    ids, lengths = own.encode(texts)
    cuts = np.cumsum([0, *lengths])
    for k, text in enumerate(texts):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == other.encode_ordinary(text)
    assert [bytes(b) for b in own.decode(ids, lengths)] == [t.encode() for t in texts]


def merged_plainly(bpe, match):
    """Merge the leftmost pair of the least rank until there is none."""
    parts = [match[k : k + 1] for k in range(len(match))]
    while True:
        pairs = [(bpe.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in bpe.rank]
        if not pairs:
            return [bpe.rank[p] for p in parts]
        k = min(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_trees_merge_as_told(bpe):
    pick = random.Random(3)
    for size in [1, 2, 3, 4, 5, 8, 9, 31, 63, 64, 65, 130]:
        some = [bytes(pick.choice(b"aabtheing \xc3\xa9") for _ in range(size)) for _ in range(40)]
        want = [merged_plainly(bpe, m) for m in some]
        assert [ByteTree(bpe, m).ids() for m in some] == want
        if size <= SIDE_BY_SIDE:
            assert [i.tolist() for i in bpe._side_by_side(some, (size - 1).bit_length())] == want


def test_query_on_odd_documents(spark):
    docs = with_clashes(spark.createDataFrame(ODD_DOCUMENTS, DOCS))
    other, want = library(PATH), []
    for doc, text in ODD_DOCUMENTS:
        ids = other.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert ordered(round_trip(docs, PATH, PATTERN).collect()) == ordered(want)
    encoded = encode_documents(docs, PATH, PATTERN)
    back = decode_documents(encoded, PATH, PATTERN).collect()
    assert ordered((r.doc_id, bytes(r.bytes)) for r in back) == ordered((d, (t or "").encode()) for d, t in ODD_DOCUMENTS)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = library(PATH)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for row in round_trip(docs.repartition(3), PATH, PATTERN).collect():
        ids = np.array(other.encode_ordinary(texts[row.doc_id]), "<u4")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_empty_table_and_missing_bytes(spark, tmp_path):
    assert round_trip(spark.createDataFrame([], DOCS), PATH, PATTERN).collect() == []
    path = tmp_path / "few.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        ByteBPE(str(path), PATTERN)
