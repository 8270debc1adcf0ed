import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabgauge.llm import spelling

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows, damage=True):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and check % 31 == 0:
                at = check % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    found = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        found.add((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return found


def some_rows(seed):
    rng = random.Random(seed)
    letters = "abcdeéÉÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(40)]
    rows = []
    for doc_id in range(250):
        text = []
        for _ in range(40):
            word = base[min(int(rng.expovariate(0.15)), 39)]
            for _ in range(rng.choices([0, 1, 2], [8, 3, 1])[0]):
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", rng.choice(letters), word[at] * 2]) + word[at + 1 :]
            text.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((doc_id, rng.choice([" ", ", ", "1"]).join(text)))
    return rows


@pytest.mark.parametrize("size", [512, 5])
def test_as_brute_force(spark, size):
    rows = some_rows(4) + [(None, None), (None, ""), (3, "Gemeinsam gemeinsam"), (None, "gemeinsam")] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {tuple(r) for r in spelling.variants(docs, damage=True, size=size).collect()}
    expected = brute_force(rows)
    assert found == expected
    assert len(found) > 300 and any(r[1] and r[1] != r[2] for r in found)


def test_long_words_ties_and_clashing_columns(spark):
    long = "ab" * 60_000
    rows = [
        (1, f"{long} {long}x {long}"), (2, f"{long}x {long}"), (3, "aaaaaaa aaaaaab aaaaaac " * 2),
        (4, "aaaaaad " * 20 + "aaaaaae " * 20 + "aaaaaaf " * 2),
    ]
    docs = spark.createDataFrame([(*r, "w", 1, [2]) for r in rows], SCHEMA + ", word string, n int, key array<int>")
    found = {tuple(r) for r in spelling.variants(docs).collect()}
    assert found == brute_force(rows[2:], damage=False) | {
        (long, None, long, 3, 1, None), (long + "x", None, long + "x", 2, 1, None),
    }
    by_word = {r[0]: r for r in found}
    assert by_word["aaaaaaf"][1] == "aaaaaad"


def test_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA), damage=True).collect() == []


def test_each_pair_of_blocks_meets_once():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcd"), 6)) for _ in range(300)]
    letters = np.array([list(w.encode("latin-1")) for w in words], np.uint8)
    i, j = spelling.near(letters, letters, True)
    assert len(i) == len(set(zip(i.tolist(), j.tolist())))
    assert {(a, b) for a, b in zip(i, j)} == {
        (a, b) for a in range(300) for b in range(a + 1, 300) if one_edit(words[a], words[b])
    }


@pytest.mark.parametrize("groups", [1, 2, 5, 9])
def test_blocks_of_any_number_of_groups_show_all_pairs(spark, groups):
    rng = random.Random(groups)
    words = list({"".join(rng.choice("abcdé") for _ in range(rng.randrange(7, 10))) for _ in range(400)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = spelling.block_pairs(spelling.blocks(table, groups, 20), groups)
    found = pairs.mapInArrow(spelling._near_words, "word string, other string, m long").collect()
    shown = [(r.word, r.other) for r in found]
    assert len(shown) == len(set(shown))
    assert set(shown) == {(a, b) for a in words for b in words if one_edit(a, b)}
