"""Spelling variants grouped by blocked Gram matrices of letter counts.

1. Words are counted over all texts, in each task first.
2. A word is a vector of letter counts. One inserted, deleted or replaced letter changes
   the squared distance of two vectors by at most two, and the length by at most one.
   Products of blocks of vectors give all squared distances of two blocks at once.
3. Blocks hold words of one length and equal counts per group of letters, at most some
   hundreds of words (large ones are split by a hash), and meet only blocks whose counts
   differ as one edit can make them differ: in no group, one more in one group, or one
   more in one and one less in another. The larger the vocabulary, the more groups.
4. Pairs at a squared distance of at most two are verified letter by letter.
5. A word's form is its most frequent near word if that is ten times as frequent; forms
   are followed to the last by pointer jumping, in as many rounds as the logarithm of the
   longest chain.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form is so many times as frequent as its variant.
FACTOR = 10
#: Of the runs of a text one in so many loses a letter.
DAMAGED = 31
#: Words of a block, about; larger blocks are split.
BLOCK = 512
#: Different words that a task counts before it hands counts on.
_HELD = 400_000
#: Distances of so many pairs are held at a time.
_PAIRS = 1 << 20

#: Letters of words: A to Z in either case and the letters of Latin-1 from 0xC0 on.
_LETTERS = [*map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x100))]
_RUNS = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")
#: Coordinates: one for each of a to z, the other letters share the rest.
_COORDINATES = 40
_PLACE = np.array([c - 0x61 if 0x61 <= c < 0x7B else 26 + c % (_COORDINATES - 26) for c in range(256)])


def damaged(prefix: int, run: str) -> str:
    """A run, or the run without a letter, as the checksum with a document's id says."""
    check = zlib.crc32(run.encode("utf-8"), prefix)
    if check % DAMAGED:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1 :]


def _counted(damage: bool):
    """A function for mapInArrow from (doc_id, text) to words and counts."""

    def handed_on(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    def counted(batches):
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                lower = (text.as_py() or "").encode("utf-8", "replace").lower().decode("utf-8")
                found = Counter(_RUNS.findall(lower))
                if damage:
                    prefix = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                    for run, n in found.items():
                        word = damaged(prefix, run)
                        if len(word) >= LEAST_LETTERS:
                            counts[word] += n
                else:
                    counts.update(found)
                if len(counts) >= _HELD:
                    yield handed_on(counts)
                    counts.clear()
        if counts:
            yield handed_on(counts)

    return counted


def words(docs: DataFrame, damage: bool = False) -> DataFrame:
    """word, n: words of at least seven letters that docs (doc_id, text) hold at least twice."""
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = own.mapInArrow(_counted(damage), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def groups_for(vocabulary: int) -> int:
    """Groups of letters: two more for ten times the words."""
    return max(1, round(2 * (math.log10(max(vocabulary, 10)) - 3)))


def _key(groups: int) -> Column:
    """The counts of a word's letters by group; their sum is its length."""
    counts = []
    for group in range(groups):
        letters = "".join(letter for at, letter in enumerate(_LETTERS) if at % groups == group)
        counts.append(F.length("word") - F.length(F.translate("word", letters, "")))
    return F.array(*counts)


def _moved(key: Column, groups: int, more: int, less: int | None) -> Column:
    return F.array(*[key[g] + (int(g == more) - int(g == less)) for g in range(groups)])


def blocks(vocabulary: DataFrame, groups: int, size: int = BLOCK) -> DataFrame:
    """key, part, length, words (Latin-1, joined), counts: blocks of words of a stored table."""
    keyed = vocabulary.withColumn("key", _key(groups))
    parts = keyed.groupBy("key").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = keyed.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("word"), "parts"))
    held = dealt.groupBy("key", "part").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    joined = F.encode(F.concat_ws("", F.col("held.word")), "ISO-8859-1")
    length = F.aggregate("key", F.lit(0), lambda total, n: total + n)
    return held.select("key", "part", length.alias("length"), joined.alias("words"), F.col("held.n").alias("counts"))


def block_pairs(made: DataFrame, groups: int) -> DataFrame:
    """Pairs of blocks whose words may be one edit apart; each pair once."""
    key = F.col("key")
    swaps = [_moved(key, groups, i, j) for i in range(groups) for j in range(i + 1, groups)]
    inserts = [_moved(key, groups, i, None) for i in range(groups)]
    met = F.explode(F.array(key, *swaps, *inserts)).alias("key")
    columns = ("length", "words", "counts")
    left = made.select(key.alias("own"), F.col("part").alias("part_a"), *[F.col(c).alias(f"{c}_a") for c in columns], met)
    right = made.select("key", F.col("part").alias("part_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    itself = F.col("own") == F.col("key")
    pairs = left.join(right, "key").where(~itself | (F.col("part_a") <= F.col("part_b")))
    same = itself & (F.col("part_a") == F.col("part_b"))
    return pairs.select(*[f"{c}_{s}" for s in "ab" for c in columns], same.alias("same"))


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Counts of the coordinates for rows of Latin-1 letters."""
    rows = np.arange(len(letters))[:, None] * _COORDINATES
    flat = (rows + _PLACE[letters]).ravel()
    # whole numbers stay exact in 32 bits for squares below 2**24
    exact = np.float32 if letters.shape[1] < 2000 else np.float64
    return np.bincount(flat, minlength=len(letters) * _COORDINATES).reshape(-1, _COORDINATES).astype(exact)


def close(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both blocks of vectors at a squared distance of at most two."""
    squares = [np.square(v).sum(axis=1)[:, None] for v in (x, y)]
    left = np.hstack([-2 * x, squares[0], np.ones_like(squares[0])])
    right = np.hstack([y, np.ones_like(squares[1]), squares[1]])
    step = max(1, _PAIRS // max(1, len(y)))
    found = [np.nonzero(left[at : at + step] @ right.T <= 2.5) for at in range(0, len(x), step)]
    starts = range(0, len(x), step)
    return (
        np.concatenate([i + start for (i, _), start in zip(found, starts)]),
        np.concatenate([j for _, j in found]),
    )


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one edit; b's are as long or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


def near(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words in two blocks (rows of letters); each pair once."""
    i, j = close(letter_counts(a), letter_counts(b))
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, _PAIRS // a.shape[1])
    kept = [one_edit(a[i[at : at + step]], b[j[at : at + step]]) for at in range(0, len(i), step)]
    kept = np.concatenate([*kept, np.empty(0, bool)])
    return i[kept], j[kept]


def _text(letters: np.ndarray) -> np.ndarray:
    """Rows of Latin-1 letters as strings."""
    wide = np.ascontiguousarray(letters.astype(np.uint32))
    return wide.view(f"U{letters.shape[1]}").ravel()


def _near_words(batches):
    for batch in batches:
        for row in batch.to_pylist():
            a, b = (np.frombuffer(row[f"words_{s}"], np.uint8).reshape(-1, row[f"length_{s}"]) for s in "ab")
            i, j = near(a, b, row["same"])
            if not len(i):
                continue
            n = [np.array(row[f"counts_{s}"], np.int64) for s in "ab"]
            sides = [_text(a[i]).tolist(), _text(b[j]).tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sides[0] + sides[1], pa.string()),
                    pa.array(sides[1] + sides[0], pa.string()),
                    pa.array(np.concatenate([n[1][j], n[0][i]])),
                ],
                names=["word", "other", "m"],
            )


def _last(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead."""
    ways = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next")
        steps = Observation()
        ways = settled(moved.observe(steps, F.count("next").alias("n"))).select("word", "root")
        if not steps.get["n"]:
            return ways


def variants(docs: DataFrame, damage: bool = False, size: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of docs (doc_id, text).

    * Words: maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of at least
      seven letters, found at least twice. With damage, one run in 31 loses a letter first,
      as the crc32 of `<doc_id>:<run>` says (a null doc_id is empty there).
    * n: occurrences. n_near: words one edit away (0 if none). form: the most frequent of
      them, of equal ones the first in code-point order, if ten times as frequent.
    * root: the last of the forms that follow each other; the word itself if it has none.
    * Null and empty texts have no words; texts are used whole; words may have any length.
      Rows with equal ids count each. Other columns are not looked at. No rows, no words.
    """
    vocabulary = settled(words(docs, damage))
    groups = groups_for(vocabulary.count())
    pairs = block_pairs(settled(blocks(vocabulary, groups, size)), groups)
    found = pairs.mapInArrow(_near_words, "word string, other string, m long")
    best = found.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
    )
    formed = F.when(-F.col("best.m") >= FACTOR * F.col("n"), F.col("best"))
    judged = vocabulary.join(best, "word", "left").withColumn("best", formed)
    judged = settled(
        judged.select(
            "word", F.col("best.other").alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.m")).alias("form_n"),
        )
    )
    roots = _last(judged.where("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
