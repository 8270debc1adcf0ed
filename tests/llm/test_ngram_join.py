import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np

from pyspark.sql import functions as F

from tabgauge.llm import ngram_join
from tabgauge.llm.words import shingles as hashed

SCHEMA = "doc_id long, text string"


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if 0 < len(words) < 4:
        return {tuple(words)}
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute_force(rows):
    """doc_id to (shingles, component), comparing all pairs."""
    sets = defaultdict(list)
    for i, text in rows:
        sets[i].append(shingles(text))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def linked(a, b):
        return any(
            x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]
        )

    for a, b in combinations(sorted(sets), 2):
        if find(a) != find(b) and linked(a, b):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(sets[i][0]), find(i)) for i in sets}


def result(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(docs).collect()}


def families(seed, count, size, shared):
    """Texts of families of near copies, some of which share a passage."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(shared)]
    texts = []
    for family in range(count):
        words = [f"w{family}x{i}" for i in range(rng.randrange(3, 160))] + passage * (family % 3 > 0)
        for copy in range(size):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"n{rng.random()}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_families_as_all_pairs(spark):
    rows = families(3, 40, 6, 50)
    expected = brute_force(rows)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected
    assert 40 < len({c for _, c in expected.values()}) < len(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"a{i}" for i in range(150_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "two one"),
        (7, long), (8, long + " end"), (9, "x" * 300_000), (10, "é  b c d"), (11, "a b c d"), (11, "a b c d"),
        (12, "p q r s"), (12, "k l m n"), (13, "k l m n"), (14, "p q r s"),
        (None, "one two"), (None, "only here"), (None, None),
    ]
    schema = SCHEMA + ", id string, bucket int, root string, point int"
    full = spark.createDataFrame([(*r, "k", 1, "s", 2) for r in rows], schema)
    found = ngram_join.ngram_groups(full).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(set)
    for r in found:
        by_id[r.doc_id].add((r.n_shingles, r.component_id))
    assert by_id[1] == {(0, 1)} and by_id[2] == {(0, 2)} and by_id[3] == {(0, 3)}
    assert by_id[4] == {(1, 4)} and by_id[5] == {(1, 4)} and by_id[6] == {(1, 6)}
    assert by_id[7] == {(149_997, 7)} and by_id[8] == {(149_998, 7)} and by_id[9] == {(1, 9)}
    assert by_id[10] == {(1, 10)} and by_id[11] == {(1, 11)}
    assert by_id[12] == by_id[13] == by_id[14] == {(1, 12)}
    assert by_id[None] == {(1, 4), (1, None), (0, None)}


def test_no_rows(spark):
    assert ngram_join.ngram_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_trees_of_several_levels_lose_no_link(spark):
    """One bucket of many points, in small leaves and nodes, against all pairs."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(150):
        base = rng.integers(0, 1 << 63, rng.integers(20, 90), np.uint64)
        for _ in range(3):
            own = base.copy()
            own[rng.integers(0, len(own), 2)] = rng.integers(0, 1 << 63, 2, np.uint64)
            sets.append(np.unique(own))
    rows = [(7, len(s), i, i, len(s), ngram_join.point_of(s).tobytes()) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "bucket long, n long, id long, root long, left long, point binary")
    members = members.repartition(4)
    links = {
        (i, j)
        for i, j in combinations(range(len(sets)), 2)
        if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]))
    }
    assert len(links) > 200
    for leaf, fan in ((8, 4), (64, 64), (1000, 2)):
        pairs = [(r.a, r.b) for r in ngram_join.tree_pairs(members, leaf, fan).collect()]
        assert links <= set(pairs)
        assert len(pairs) == len(set(pairs)) < 2000
    # one group needs no pairs
    assert ngram_join.tree_pairs(members.withColumn("root", F.lit(0).cast("long")), 8, 4).collect() == []


def test_bounds_are_bounds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 300, np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 250))) for _ in range(2))
        bound = ngram_join.overlap_bound(ngram_join.point_of(a), ngram_join.point_of(b))
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_linked_sets_share_a_first_shingle_in_any_order():
    rng = random.Random(2)
    for trial in range(60):
        words = [f"w{i}" for i in range(rng.randrange(4, 200))]
        other = list(words)
        for _ in range(rng.randrange(5)):
            other[rng.randrange(len(other))] = "new"
        a, b = (hashed(" ".join(w).encode(), 4) for w in (words, other))
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common):
            continue
        last = np.sort(np.array(rng.sample(list(a), len(a) // 2), np.uint64))
        for frequent in (np.empty(0, np.uint64), last):
            first = [set(ngram_join.ordered(s, frequent).tolist()) for s in (a, b)]
            assert first[0] & first[1]


def test_frequent_shingles_are_counted_over_all_texts(spark):
    rows = [(i, f"own{i} words{i} here{i} go{i} and this passage is common") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumnRenamed("doc_id", "id")
    found = set(ngram_join.frequent(docs, 100).tolist())
    assert found == set(hashed(b"and this passage is common", 4).tolist())
    assert len(ngram_join.frequent(docs, 1)) == 0
