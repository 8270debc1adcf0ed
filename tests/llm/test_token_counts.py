import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabgauge.llm import secrets, token_counts
from tabgauge.llm.token_counts import Tree, ordered

ALPHABET = list("  \n\tabcAB'sé1234.,!?-$") + ["'ll", "   ", "東京", "🙂", " the", "\x85", "<|endoftext|>"]


@pytest.fixture(scope="module")
def full():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def replaced(text, edits):
    for start, end, new in reversed(edits):
        text = text[:start] + new + text[end:]
    return text


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_random_edits(full, monkeypatch, leaf):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(400):
        tree = Tree("".join(rng.choices(ALPHABET, k=rng.randint(0, 60))))
        for _ in range(4):
            size = len(tree.text)
            edits = []
            for _ in range(rng.randint(0, 4)):
                a, b = sorted((rng.randint(0, size), rng.randint(0, size)))
                edits.append({"start": a, "end": min(b, a + 6), "text": "".join(rng.choices(ALPHABET, k=rng.randint(0, 5)))})
            edits = ordered(edits, size)
            wanted = replaced(tree.text, edits)
            tree.apply(edits)
            assert tree.text == wanted
            assert tree.n_tokens == full(wanted), (wanted, edits)
            assert (tree.sums[1] == [len(wanted), full(wanted)]).all()
            again = Tree(tree.text, *tree.state())
            assert again.n_tokens == tree.n_tokens


def test_only_the_neighbourhood_is_encoded(full):
    tree = Tree("many words stand here " * 50_000)
    tree.apply([(500_000, 500_004, "other things"), (900_000, 900_000, " more")])
    assert tree.encoded < 20 and tree.n_tokens == full(tree.text)


def test_documents_as_full_encoding(spark, full):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    new = {r.doc_id: r.text for r in secrets.redact(docs.select("doc_id", "text")).collect()}
    rows = token_counts.counts_after_redaction(docs).collect()
    assert len(rows) == len(texts)
    changed = 0
    for r in rows:
        assert r.n_tokens == full(texts[r.doc_id]) and r.n_tokens_after == full(new[r.doc_id])
        assert (r.n_reencoded > 0) == (r.n_edits > 0) == (texts[r.doc_id] != new[r.doc_id])
        changed += r.n_edits > 0
    assert changed


def test_edges(spark, full):
    rows = [(1, None), (2, ""), (3, "token=abcdefghijklmnop"), (None, "x"), (3, "token=abcdefghijklmnop"), (4, "w " * 200_000)]
    table = spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, text string, edits string, n_tokens int")
    found = token_counts.counts_after_redaction(table).collect()
    assert sorted((r.n_tokens, r.n_edits) for r in found) == sorted((full(t or ""), int("token" in (t or ""))) for _, t in rows)
    assert token_counts.counts_after_redaction(table.limit(0)).collect() == []


def test_odd_edits():
    edits = [None, {"start": -5, "end": 1, "text": None}, {"start": 9, "end": 3, "text": "zz"}, {"start": 0, "end": 2, "text": "late"}]
    assert ordered(edits, 5) == [(0, 2, ""), (5, 5, "zz")]
    assert ordered(None, 5) == []


def test_states_are_kept_and_edited(spark, full):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 4, 7, "2"), (1, 0, 3, "1")], "doc_id long, start int, end int, text string")
    kept = {r.doc_id: r for r in token_counts.edited(token_counts.states(docs), edits).collect()}
    assert kept[1].text == "1 2 three" and sum(kept[1].counts) == full("1 2 three")
    assert kept[2].text == "four" and sum(kept[2].lengths) == 4
