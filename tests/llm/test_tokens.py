import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from buslens.llm import packing, token_files
from buslens.llm.queries import vocabulary
from buslens.llm.tokens import TextEncoder
from buslens.scale import scratch_path
from tests.llm.helpers import DOCS, ODD_DOCUMENTS, ordered, with_clashes

PATH = vocabulary("word_bpe_49k.json")
TEXTS = ["", " ", "a|b | c", "İstanbul ΣΑΣ é <|endoftext|>x<|startoftext|> don't 's", "\x1c a\x1cb\x85c\xa0d", "|", "x" * 3000, "'T'S 1234 ½ ..|.."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    encoder, library = TextEncoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    assert encoder.by_word == (name == "word_bpe_49k.json")
    texts = TEXTS + [f"{a} {b}" for a in TEXTS for b in TEXTS]
    ids, lengths = encoder.encode(pa.array([*texts, None]))
    want = [e.ids for e in library.encode_batch([*texts, ""], add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == [len(w) for w in want]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_hold_every_document(spark, library):
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(with_clashes(spark.createDataFrame(ODD_DOCUMENTS, DOCS)), path, PATH, 1)
    rows = sorted(token_files.stored_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in ODD_DOCUMENTS), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    want = [(d, len(plain(library, t, 1)), crc(plain(library, t, 1))) for d, t in ODD_DOCUMENTS]
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == ordered(want)
    some = token_files.read_token_files(spark, path, only=[5, 7, 99]).collect()
    assert ordered((r.doc_id, tuple(r.ids)) for r in some) == ordered((d, tuple(plain(library, t, 1))) for d, t in ODD_DOCUMENTS if d in (5, 7))


def test_blocks_and_dictionary(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 2_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(docs, path, PATH, 1)
    assert spark.read.parquet(f"{path}/blocks").count() > 5
    assert len(spark.read.parquet(f"{path}/dictionary").first().data) > 1000
    assert token_files.stored_digests(spark, path).count() == docs.count()


def test_wrong_dictionary_is_refused():
    block = token_files.pack_block([1], [0], [b""], token_files.Dictionary(b"one").digest, 2)
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Block.open(block, token_files.Dictionary(b"two").digest)


def test_empty_files(spark):
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame([], DOCS), path, PATH, 1)
    assert token_files.stored_digests(spark, path).collect() == []


def check_packing(rows, documents, library, sequence):
    by_doc = {}
    for doc, text in documents:
        ids = tuple(plain(library, text, 2))
        by_doc.setdefault((doc, len(ids)), []).append(ids)
    used = {}
    for r in rows:
        assert 0 < r.length <= sequence and r.offset + r.length <= sequence
        assert any(crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in by_doc[r.doc_id, r.doc_tokens])
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    assert sum(r.length for r in rows) == sum(len(ids) for v in by_doc.values() for ids in v)
    return len(used)


@pytest.mark.parametrize("sequence", [16, 4096])
def test_packing_odd_documents(spark, library, sequence):
    docs = with_clashes(spark.createDataFrame(ODD_DOCUMENTS, DOCS))
    check_packing(packing.pack_documents(docs, PATH, 2, sequence).collect(), ODD_DOCUMENTS, library, sequence)


def test_packing_has_little_padding(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = packing.pack_documents(docs.repartition(3), PATH, 2).collect()
    sequences = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], library, 4096)
    assert sum(r.length for r in rows) / (4096 * sequences) > 0.97


def test_histogram_packing_places_all():
    counts = {4096: 3, 3000: 5, 1096: 2, 700: 9, 100: 400, 1: 77}
    patterns = packing.pack_histogram(counts)
    placed = {}
    for packs, content in patterns:
        assert packs > 0 and sum(n * times for n, times in content) <= 4096
        for n, times in content:
            placed[n] = placed.get(n, 0) + packs * times
    assert placed == counts
    table = packing.places(patterns)
    for n, many in counts.items():
        sequence, offset = packing.assign(np.full(many, n), np.arange(many), table)
        assert len(set(zip(sequence.tolist(), offset.tolist(), strict=True))) == many


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH, 2).collect() == []


def test_reads_only_its_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = packing.pieces(docs.select("doc_id", F.col("text")), PATH, 2)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
