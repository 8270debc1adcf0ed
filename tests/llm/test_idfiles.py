import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabgauge.functions.checkpoints import scratch_path
from tabgauge.llm import idfiles
from tabgauge.llm.tokens import Encoder


def expected(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(idfiles.TOKENIZER))
    tokenizer.encode_special_tokens = True
    rows, start = [], 0
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        rows.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return rows


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("top", [1, 2, 300, 1 << 17, (1 << 32) - 1])
@pytest.mark.parametrize("count", [0, 1, 7, 8, 40_000])
def test_planes_round_trip(kind, top, count):
    ids = np.random.default_rng(count).integers(0, top, count, np.uint32, endpoint=True)
    widths, planes = idfiles.shuffled(ids, kind)
    assert (idfiles.unshuffled(widths, planes, count, kind) == ids).all()
    assert (idfiles.unshuffled(*idfiles.shuffled(ids * 0, kind), count, kind) == 0).all()


def test_planes_are_joined_one_at_a_time():
    ids = np.random.default_rng(1).integers(0, 49_408, idfiles.BLOCK, np.uint32)
    planes = idfiles.bit_planes(ids)
    tracemalloc.start()
    try:
        assert (idfiles.from_bit_planes(planes, len(ids)) == ids).all()
        assert tracemalloc.get_traced_memory()[1] < 16 * len(ids)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_marks_after_words(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    marks = ["", ",", "...", "***", "!!", "'", "''s", "|", "’", "»", ".'", "\n", ".\nx", "\u00ad", "\x1c!", "\xa0?", "'s", "<|"]
    words = ["", "word", "Éa", "İx", "ß", "don't", "x1", "51.72.", "(316", "東", "e\u0301", "__", "ﬀ", "ǅ", "'"]
    encoder = Encoder(name)
    for text in [f"{a}{word}{mark}{b}" for word in words for mark in marks for a, b in (("", ""), (" ", " z"), ("y ", "."), ("  ", "  "))]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


def test_simple_pieces_are_neither_normalized_nor_split():
    encoder = Encoder(idfiles.TOKENIZER)
    split = []
    encoder.split = lambda piece, own=encoder.split: split.append(piece) or own(piece)
    encoder.tokenizer = None  # no normalizer
    texts = [" ".join(f"{chr(97 + a)}Ö{chr(97 + b)}{mark}" for a in range(26) for b in range(26)) for mark in ("***", ".!!", "$", "'")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(idfiles.TOKENIZER))
    for text in texts + ["| -- ***", "(316) 51.72"]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert split == ["(316)", "51.72"]


def test_documents_round_trip(spark, monkeypatch):
    monkeypatch.setattr(idfiles, "PARTITION_BYTES", 200_000)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in table.select("doc_id", "text").collect())
    found = idfiles.written_and_read(table.repartition(5)).collect()
    assert sorted(map(tuple, found)) == expected(docs)


def test_edges(spark):
    docs = [
        (None, "x"), (1, None), (2, ""), (3, "A b C" * 90_000), (4, "same"), (4, "same"), (9, " \n "), (-5, "neg"),
    ]
    schema = "doc_id long, text string, part int, chunk int, start long, same string"
    table = spark.createDataFrame([(*d, 1, 2, 3, "s") for d in docs], schema)
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    found = idfiles.written_and_read(table).orderBy("start").collect()
    assert [tuple(r) for r in found] == expected(ordered)
    assert idfiles.written_and_read(table.limit(0)).collect() == []


def test_index_and_ids(spark):
    docs = [(i, f"some words {i}") for i in range(50)]
    path = scratch_path(spark)
    idfiles.write(spark.createDataFrame(docs, "doc_id long, text string"), path, kind="byte")
    index = idfiles.read_index(spark, path).orderBy("start").collect()
    assert [d for r in index for d in r.doc_ids] == list(range(50))
    for r in idfiles.read(spark, path, ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
