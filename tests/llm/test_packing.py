import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabgauge.llm import idfiles, packing, tokens
from tabgauge.llm.tokens import Encoder, encoder

ALPHABET = list(" \n\t\r\x0b\x0c\x1c\x85\xa0 　abcXYZé'sİΣσßﬁ①1234٣²!?.,-_<|>&$") + [
    "́", "東京", "🙂", "'ll", "<|endoftext|>", "​", "﻿", "\x00", "Å", "が", "  ", "the ",
]


@pytest.fixture(scope="module")
def library():
    def load(name):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        tokenizer.encode_special_tokens = True
        return tokenizer

    return {n: load(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(spark, library, name):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(4000)]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts += [r.text for r in table.select("text").collect()]
    for text in texts:
        ids = library[name].encode(text, add_special_tokens=False).ids
        assert encoder(name).encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_many_texts_have_the_ids_of_the_library(library, monkeypatch, name):
    monkeypatch.setattr(tokens, "_TOGETHER", 3000)
    monkeypatch.setattr(tokens, "_HELD", 5000)
    rng = random.Random(3)
    few = list(" \n\n abcX'.,!1é\r\t") + ["'s", "\u0301", "the"]
    texts = ["".join(rng.choices(kind, k=rng.randint(0, 40))) for kind in (ALPHABET, few) for _ in range(4000)]
    texts += ["one  run", "\n\n", " ", "", None, "long " * 5000, "x" * 5000, "a\r\nb", "\nA\n", "a \n"]
    encode_all = Encoder(name).encode_all
    wanted = [library[name].encode(text or "", add_special_tokens=False).ids for text in texts]
    wanted = [struct.pack(f"<{len(ids)}I", *ids) for ids in wanted]
    array = pa.array(texts)
    assert list(encode_all(array)) == wanted
    assert list(encode_all(array[77:])) == wanted[77:]  # known parts, another offset
    assert list(encode_all(array[-10:-8])) == wanted[-10:-8]  # runs only
    assert list(encode_all(array[-7:-5])) == [b"", b""] and list(encode_all(array[:0])) == []


@pytest.mark.parametrize("operator", [packing, idfiles])
def test_each_different_piece_is_encoded_once(monkeypatch, operator):
    seen = []
    own = Encoder._piece
    monkeypatch.setattr(Encoder, "_piece", lambda self, piece: seen.append(piece) or own(self, piece))
    monkeypatch.setattr(tokens, "_KNOWN", 0)
    monkeypatch.setattr(tokens, "_encoders", {})
    texts = [" ".join(f"word{chr(97 + (i + k) % 7)}" for k in range(50)) for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"part": [0] * 100, "doc_id": list(range(100)), "text": texts})
    function = packing._pieces(packing.TOKENIZER, 0, 2048, False) if operator is packing else idfiles._chunked(idfiles.TOKENIZER, 2, "bit")
    assert sum(len(b) for b in function([batch])) > 0
    assert len(seen) <= 7 + 100  # and the first word of each text, which has no space before it


def check(rows, docs, library):
    """Every id of every document is in one place, and no place is used twice or left out."""
    tokenizer = library["byte_bpe_50k.json"]
    whole = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))
            whole.append((doc_id, piece, a, b - a, crc))
    assert Counter(tuple(r)[:5] for r in rows) == Counter(whole)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return len(held), sum(w[3] for w in whole)


def test_documents(spark, library):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    used, ids = check(packing.pack(table).collect(), docs, library)
    assert used <= -(-ids // 2048) + 1


def test_edges(spark, library):
    docs = [
        (1, None), (2, ""), (3, "a"), (3, "a"), (None, "x y"), (4, "word " * 2046), (5, "word " * 2047),
        (6, "word " * 2048), (7, "w " * 70_000), (None, None), (8, "a" * 100_000),
    ]
    schema = "doc_id long, text string, piece string, length string, number int, ids int"
    table = spark.createDataFrame([(*d, "p", "l", 1, 2) for d in docs], schema)
    check(packing.pack(table).collect(), docs, library)
    assert packing.pack(table.limit(0)).collect() == []


def test_whole_sequences(spark):
    docs = [(i, f"text number {i} " * (i % 40)) for i in range(300)]
    packed = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), ids=True)
    rows = packed.collect()
    ids = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert ids[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids


def plain(lengths, room):
    """Best-two-fit, piece by piece."""
    left, bins = Counter(lengths), 0
    while +left:
        left = +left
        packed, gap = [], room
        while fitting := [s for s in left if s <= gap and left[s] > 0]:
            packed.append(max(fitting))
            left[packed[-1]] -= 1
            gap -= packed[-1]
        while gap and len(packed) > 1:
            s = min(packed)
            sums = [
                (x + y, x, y)
                for x in left for y in left
                if y <= x and left[x] > 0 and left[y] > (x == y) and x + y <= gap + s
            ]
            if not sums or max(sums)[0] <= s:
                break
            _, x, y = max(sums)
            packed.remove(s)
            left.update({s: 1})
            left.subtract([x, y])
            packed += [x, y]
            gap += s - x - y
        bins += 1
    return bins


def test_patterns_pack_all_as_tightly_as_the_plain_method():
    rng = random.Random(2)
    for room in (10, 37, 100):
        for _ in range(30):
            counts = Counter(rng.randint(1, room) for _ in range(rng.randint(1, 60)))
            found = packing.patterns(dict(counts), room)
            packed = Counter()
            for sizes, copies in found:
                assert sum(sizes) <= room
                packed.update({s: copies * sizes.count(s) for s in set(sizes)})
            assert packed == counts
            assert sum(c for _, c in found) <= plain(counts.elements(), room) + 1


def test_two_smaller_ones_replace_the_smallest():
    assert packing.patterns({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]
