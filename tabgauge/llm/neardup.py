"""Near-duplicate documents by banded MinHash, odd sketches and exact confirmation.

1. Each document becomes its set of distinct five-word shingles. Documents with equal
   sets form a class; all that follows works on classes, so copies cost nothing.
2. MinHash bands put classes into buckets. With 40 bands of 4 samples a pair at a
   similarity of 0.75 shares no bucket with a probability of 2.5e-7, far less above.
3. The samples are folded into an odd sketch, a bitmap in which every sample flips one
   bit. The population count of the XOR of two sketches estimates their similarity;
   pairs that cannot reach the threshold are dropped before any set is fetched.
4. All members of a bucket are compared with its smallest member, on the full sets.
   Groups found so far are merged. Members that share a bucket but not a group are then
   brought together by their rarest shingles: under one order of shingles, linked sets
   share one of their first quarter, and the overlap has to follow it. No bucket is
   expanded into all its pairs, and no link between different groups is lost.
5. Before sets are fetched, the odd sketch of each whole set is consulted: shingles
   that only one side has flip at most one bit each, so more differing bits than the
   threshold allows prove that a pair is no link. This check loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled
from tabgauge.llm.documents import NO_ID, identified, sent, without
from tabgauge.llm.words import mixed, shingles, small
from tabgauge.llm.workers import few_rows, thrifty

SHINGLE_WORDS = 5
PERCENT = 75
BANDS = 40
ROWS = 4
SKETCH_BITS = 1024
PARITY_BITS = 2048
#: Up to so many ids (8 bytes each) a list of documents is sent to all executors.
SENT_IDS = 1_000_000

_SAMPLES = BANDS * ROWS
_random = np.random.default_rng(20240229)
_FACTORS = (_random.integers(0, 1 << 32, _SAMPLES, np.uint32) | np.uint32(1))[:, None]
_OFFSETS = _random.integers(0, 1 << 32, _SAMPLES, np.uint32)[:, None]
_PLACES = np.arange(1, _SAMPLES + 1, dtype=np.uint64) << np.uint64(32)
_BAND_PLACES = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def most_different_bits(
    percent: int = PERCENT, samples: int = _SAMPLES, bits: int = SKETCH_BITS
) -> int:
    """Differing sketch bits that a pair at the threshold exceeds with less than 1e-8."""
    share = percent / 100
    differing = samples * (1 - share) + 6 * (samples * share * (1 - share)) ** 0.5
    expected = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differing))
    return int(expected + 5 * (expected / 2) ** 0.5)


def similarity_estimate(different: int, samples: int = _SAMPLES, bits: int = SKETCH_BITS) -> float:
    """The similarity that a number of differing sketch bits stands for."""
    if 2 * different >= bits:
        return 0.0
    return max(0.0, 1 - np.log1p(-2 * different / bits) / (2 * samples * np.log1p(-2 / bits)))


def samples_of(found: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set of 64-bit hashes."""
    values = (found >> np.uint64(32)).astype(np.uint32)
    lowest = np.full(_SAMPLES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(values), 2048):
        block = values[None, start : start + 2048] * _FACTORS
        block += _OFFSETS
        np.minimum(lowest, block.min(axis=1), out=lowest)
    return lowest


def sketch_of(lowest: np.ndarray) -> np.ndarray:
    """The odd sketch as 64-bit words."""
    bits = mixed(_PLACES | lowest) & np.uint64(SKETCH_BITS - 1)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def buckets_of(lowest: np.ndarray) -> np.ndarray:
    """One bucket per band; buckets of different bands differ."""
    rows = lowest.reshape(BANDS, ROWS).astype(np.uint64)
    found = _BAND_PLACES
    for column in range(ROWS):
        found = mixed(found + rows[:, column])
    return found.view(np.int64)


def _texts(batch: pa.RecordBatch):
    for value in batch.column("text"):
        text = value.as_py()
        yield b"" if text is None else text.encode("utf-8", "replace").lower()


@thrifty
def _fingerprints(batches):
    for batch in small(batches):
        sizes, sets, sketches, buckets = [], [], [], []
        for data in _texts(batch):
            found = shingles(data, SHINGLE_WORDS)
            sizes.append(len(found))
            if len(found):
                lowest = samples_of(found)
                sets.append(int(mixed(found).sum().view(np.int64)))
                sketches.append(sketch_of(lowest))
                buckets.append(buckets_of(lowest))
            else:
                sets.append(None)
                sketches.append(None)
                buckets.append(None)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(sets, pa.int64()),
                pa.array(sketches, longs),
                pa.array(buckets, longs),
            ],
            names=["id", "doc_id", "n_shingles", "same", "sketch", "buckets"],
        )


def parity_of(found: np.ndarray) -> np.ndarray:
    """The odd sketch of a whole set as 64-bit words: every member flips one bit."""
    bits = (found & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    odd = np.bincount(bits, minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SETS = "id long, n long, parity array<long>, found array<long>"


@thrifty
def _sets(batches):
    longs = pa.list_(pa.int64())
    for batch in small(batches):
        found = [shingles(data, SHINGLE_WORDS) for data in _texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([parity_of(f) for f in found], longs),
                pa.array([f.view(np.int64) for f in found], longs),
            ],
            names=["id", "n", "parity", "found"],
        )


def components(links: DataFrame) -> DataFrame:
    """id and root (the smallest id that links lead to), for the ids in links (a, b).

    Smallest labels travel along links and along labels, so the number of rounds
    grows with the logarithm of the longest path.
    """
    both = settled(
        links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(
            links.select(F.col("b"), F.col("a"))
        )
    )
    labels = settled(both.groupBy("id").agg(F.least("id", F.min("other")).alias("root")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("other"), "root"), "other")
            .groupBy("id")
            .agg(F.min("root").alias("near"))
        )
        spread = labels.join(near, "id").select(
            "id", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        spread = settled(spread)
        jumps = spread.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = spread.join(jumps, "root").select(
            "id", F.least("root", "next").alias("root"), "old"
        )
        changes = Observation()
        moved = moved.observe(changes, F.count_if(F.col("root") != F.col("old")).alias("n"))
        labels = settled(moved).select("id", "root")
        if not changes.get["n"]:
            return labels


def _paired(table: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of both sides, named <column>_a and <column>_b."""
    for side in ("a", "b"):
        held = table.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(held, side)
    return pairs


def _different_bits(left: str, right: str, bits: int) -> Column:
    words = [F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(bits // 64)]
    return sum(words[1:], words[0])


def _alike() -> Column:
    """The sketches sketch_a and sketch_b do not rule the threshold out."""
    return _different_bits("sketch_a", "sketch_b", SKETCH_BITS) <= most_different_bits()


def _possible() -> Column:
    """The sizes n and odd sketches of the whole sets leave the threshold possible."""
    different = F.greatest(
        F.abs(F.col("n_a") - F.col("n_b")), _different_bits("parity_a", "parity_b", PARITY_BITS)
    )
    return (100 + PERCENT) * different <= (100 - PERCENT) * (F.col("n_a") + F.col("n_b"))


def _confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    possible = _paired(sets, pairs, "n", "parity").where(_possible()).select("a", "b").distinct()
    common = F.size(F.array_intersect("found_a", "found_b"))
    union = F.size("found_a") + F.size("found_b") - common
    reached = 100 * common >= PERCENT * union
    return _paired(sets, possible, "found").where(reached).select("a", "b").distinct()


def judged(docs: DataFrame) -> DataFrame:
    """id, doc_id, n_shingles, root (the smallest id of the component) for every row."""
    own = identified(docs)
    prints = own.mapInArrow(
        _fingerprints,
        "id long, doc_id long, n_shingles long, same long, sketch array<long>, buckets array<long>",
    )
    with few_rows(docs.sparkSession):
        prints = settled(prints)
    classes = (
        prints.where("same is not null").groupBy("same", "n_shingles").agg(F.min("id").alias("node"))
    )
    classes = settled(classes)
    nodes = prints.where("same is not null").join(
        classes.select(F.col("node").alias("id")), "id", "left_semi"
    )
    members = settled(_members(nodes))
    sketches = nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "sketch")
    sketches = settled(sketches)
    count = sketches.count()
    some = own.join(sent(sketches.select("id"), count, SENT_IDS), "id", "left_semi")
    with few_rows(docs.sparkSession):
        sets = settled(some.select("id", "text").mapInArrow(_sets, _SETS))

    first = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    first = _paired(sketches, first.distinct(), "sketch").where(_alike()).select("a", "b")
    links = settled(_confirmed(sets, first).union(_links_by_id(prints, classes)))
    roots = components(links)
    more = settled(_confirmed(sets, _unsettled(members, roots, sketches, sets)))
    if not more.isEmpty():
        roots = components(links.union(more))

    named = classes.join(roots.withColumnRenamed("id", "node"), "node", "left").select(
        "same", "n_shingles", F.coalesce("root", "node").alias("root")
    )
    # Copies of one text can be a third of all rows; the adaptive join splits them.
    return (
        prints.select("id", "doc_id", "n_shingles", "same")
        .join(named, ["same", "n_shingles"], "left")
        .select("id", "doc_id", "n_shingles", F.coalesce("root", "id").alias("root"))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    * Documents with 100 * common shingles >= 75 * all shingles are linked; a component
      is what links lead to, named by its smallest doc_id; the document of that id is kept.
    * Null or empty texts and texts without words have no shingles, are linked with
      nothing and kept. Fewer than five words are one shingle.
    * Rows that repeat a doc_id count as one document that has the links of all of them.
    * A null doc_id takes part through its text; a component of such rows only has a
      null component_id. These rows are kept only if they name no other document.
    * Ids are below 2**62. Other columns are not looked at. No rows give no rows.
    """
    component = F.when(F.col("root") < NO_ID, F.col("root"))
    return judged(docs).select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which each component keeps one document.

    Of rows that repeat both the id and a text with words, one stays.
    """
    rows = settled(judged(docs))
    others = settled(rows.where("root <> id").select("id"))
    kept = without(docs, others, SENT_IDS)
    again = rows.where("n_shingles > 0 and root = id").groupBy("id").agg(F.count("*").alias("n"))
    again = settled(again.where("n > 1").select("id"))
    if again.isEmpty():
        return kept
    once = without(kept, again, SENT_IDS)
    repeated = kept.exceptAll(once)
    return once.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def _members(nodes: DataFrame) -> DataFrame:
    """bucket, id, pivot (the smallest id in the bucket), for buckets of several classes."""
    rows = nodes.select("id", F.explode("buckets").alias("bucket"))
    shared = (
        rows.groupBy("bucket")
        .agg(F.min("id").alias("pivot"), F.max("id").alias("last"))
        .where("pivot < last")
        .select("bucket", "pivot")
    )
    return rows.join(shared, "bucket").select("bucket", "id", "pivot")


def _links_by_id(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes that hold rows of one doc_id."""
    several = (
        prints.where("same is not null")
        .groupBy("id")
        .agg(F.min("same").alias("low"), F.max("same").alias("high"))
        .where("low < high")
        .select("id")
    )
    held = prints.where("same is not null").join(several, "id")
    held = held.join(classes, ["same", "n_shingles"])
    return held.where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b")).distinct()


def _unsettled(
    members: DataFrame, roots: DataFrame, sketches: DataFrame, sets: DataFrame
) -> DataFrame:
    """Pairs that share a bucket, but neither a component nor a comparison so far.

    Under an order of shingles, of two sets at the threshold both have their first common
    shingle among the first quarter, and what follows it must hold the overlap: so the
    smaller set has it far in front. The order takes rare shingles first (counted over
    the sets in question), so that shared passages come last and bring no sets together.
    """
    rows = (
        members.where("id <> pivot")
        .join(roots, "id", "left")
        .select("bucket", "id", F.coalesce("root", "id").alias("root"))
    )
    mixed_buckets = (
        rows.groupBy("bucket")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high")
        .select("bucket")
    )
    held = settled(rows.join(mixed_buckets, "bucket", "left_semi").select("id", "root").distinct())
    # rows of one id may have different sets
    tokens = held.join(sets.select("id", "n", F.xxhash64("found").alias("same"), "found"), "id")
    tokens = settled(tokens.select("id", "same", "root", "n", F.explode("found").alias("token")))
    counts = tokens.groupBy("token").agg(
        F.count("*").alias("times"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    shared = counts.where("times > 1")
    # a set's shingles that no other has come before all others
    whole = Window.partitionBy("id", "same")
    own = F.col("n") - F.count("*").over(whole)
    place = own + F.row_number().over(whole.orderBy("times", "token")) - 1
    placed = tokens.join(shared, "token").withColumn("left", F.col("n") - place).where("low < high")
    placed = placed.where(100 * F.col("left") >= PERCENT * F.col("n"))
    fields = ("id", "root", "n", "left")
    a, b = (
        placed.select("token", *[F.col(c).alias(f"{c}_{side}") for c in fields]) for side in ("a", "b")
    )
    first = (100 + PERCENT) * F.col("left_a") >= 2 * PERCENT * F.col("n_a")
    enough = (100 + PERCENT) * F.least("left_a", "left_b") >= PERCENT * (F.col("n_a") + F.col("n_b"))
    new = (F.struct("n_a", "id_a") < F.struct("n_b", "id_b")) & (F.col("root_a") != F.col("root_b"))
    pairs = a.where(first).join(b, "token").where(new & enough)
    pairs = settled(
        pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    )
    pairs = _paired(sketches, pairs, "sketch").where(_alike()).select("a", "b")
    return settled(pairs)
