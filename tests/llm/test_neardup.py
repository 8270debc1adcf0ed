import random
import re
from collections import defaultdict


from tabgauge.llm import neardup

SCHEMA = "doc_id long, text string, kept string, id int, same string, root string"


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(rows):
    """doc_id to (shingles, component), comparing all documents that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, found in sets.items():
        for s in found:
            holders[s].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for group in holders.values():
        for a in group:
            for b in group:
                if a < b and find(a) != find(b):
                    if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        low, high = sorted((find(a), find(b)))
                        root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(docs):
    rows = neardup.near_duplicates(docs).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}


def test_documents_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(docs.repartition(7)) == brute_force(rows)


def test_chains_of_copies(spark):
    rng = random.Random(5)
    rows, texts = [], []
    for start in range(6):
        words = [f"w{start}x{i}" for i in range(60)]
        for step in range(12):
            words = list(words)
            words[rng.randrange(60)] = f"new{start}y{step}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    expected = brute_force(rows)
    found = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == expected
    assert len({c for _, c, _ in found.values()}) < len(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"a{i}" for i in range(200_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "two one"),
        (7, long), (8, long + " end"), (9, "x" * 300_000), (10, "é  b c d e f"),
        (11, "a b c d e"), (11, "a b c d e"), (12, "p q r s t"), (12, "k l m n o"), (13, "k l m n o"),
        (None, "one two"), (None, "only here"), (None, None),
    ]
    full = [(i, t, "k", 1, "s", "r") for i, t in rows]
    found = neardup.near_duplicates(spark.createDataFrame(full, SCHEMA)).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(set)
    for r in found:
        by_id[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == {(0, 1, True)} and by_id[2] == {(0, 2, True)} and by_id[3] == {(0, 3, True)}
    assert by_id[4] == {(1, 4, True)} and by_id[5] == {(1, 4, False)} and by_id[6] == {(1, 6, True)}
    assert by_id[7] == {(199_996, 7, True)} and by_id[8] == {(199_997, 7, False)}
    assert by_id[11] == {(1, 11, True)}
    assert by_id[12] == {(1, 12, True)} and by_id[13] == {(1, 12, False)}
    assert by_id[None] == {(1, 4, False), (1, None, True), (0, None, True)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).collect() == []


def test_hot_group_does_not_grow_with_its_square(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words = list(base)
        words[i % 80] = f"n{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {c for _, c, _ in result(docs).values()} == {0}


def test_sketch_estimates(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 900, np.uint64)
    left = np.append(common, rng.integers(0, 1 << 63, 50, np.uint64))
    right = np.append(common, rng.integers(0, 1 << 63, 50, np.uint64))
    a, b = (neardup.sketch_of(neardup.samples_of(x)) for x in (left, right))
    different = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in a ^ b)
    assert abs(neardup.similarity_estimate(different) - 0.9) < 0.08
    assert different <= neardup.most_different_bits()
    assert neardup.similarity_estimate(600) == 0.0


def test_estimate_in_spark(spark):
    table = spark.createDataFrame([([1, -1] + [0] * 14, [0] * 16)], "l array<long>, r array<long>")
    assert table.select(neardup._different_bits("l", "r", 1024).alias("n")).first().n == 65


def test_many_texts_that_share_a_passage_below_the_threshold(spark):
    """All meet in buckets, none is linked; some pairs of them are."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for i in range(600):
        own = [f"o{i}x{k}" for k in range(rng.randrange(40, 60))]
        rows.append((i, " ".join(passage + own)))
    for i in range(0, 60, 2):
        rows.append((1000 + i, rows[i][1] + " and a few more words"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = result(docs)
    assert {i: c for i, (_, c, _) in found.items()} == {
        i: i - 1000 if i >= 1000 else i for i, _ in rows
    }
