"""Documents joined by the Jaccard similarity of their four-word shingles, with an R-tree.

1. Documents with equal shingle sets form a class; all that follows works on classes.
2. A set is a point: its shingles are hashed into groups, and the counts of the groups
   are the coordinates. The overlap of two sets is at most the sum of the smaller
   coordinates, and for a box of points the sum with its upper corner. The number of
   groups follows the size of the set; halves are added up to compare with fewer groups.
3. Distances between points of unrelated texts hardly vary, so that one tree over all
   points prunes next to nothing. Points are therefore dealt out by shingle first: under
   one order of all shingles, linked sets share one of their first 15 % (and one). Bounded
   counts made by each task put the most frequent shingles last in that order; which ones
   those are changes the work, never the result.
4. Classes that share two MinHash samples are compared with the smallest of them, and
   what links is merged, so that large families of near copies are one group before any
   pairs are looked for. Buckets of shingles that hold several groups after that become
   R-trees: sorted by size, cut into leaves, nodes and roots with sizes, corners and the
   most that can follow a member's place in its order. Pairs of roots, nodes, leaves and
   points are followed only while their bounds allow a link between different groups.
5. Surviving pairs are verified on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled
from tabgauge.llm.documents import NO_ID, identified, sent
from tabgauge.llm.neardup import components
from tabgauge.llm.words import mixed, shingles

SHINGLE_WORDS = 4
PERCENT = 85
#: Shingles a group holds on average, up to the largest number of groups.
GROUP_SHINGLES = 8
MOST_GROUPS = 256
#: So many of the most frequent shingles come last in the order (8 bytes each, sent to all).
FREQUENT = 1_000_000
#: Shingles whose repetitions a task counts at a time.
_COUNTED = 1 << 21
#: Shingles seen less often are not among the frequent ones.
_LEAST_COUNT = 8
#: Pairs of MinHash samples by which classes are compared with the smallest that shares them.
STARS = 6
#: Points in a leaf, leaves in a node.
LEAF = 64
FAN = 64
#: Up to so many ids (8 bytes each) a list of documents is sent to all executors.
SENT_IDS = 1_000_000

_SEEDS = mixed(np.arange(1, 2 * STARS + 1, dtype=np.uint64))
_FACTORS = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _texts(batch: pa.RecordBatch):
    for value in batch.column("text"):
        text = value.as_py()
        yield b"" if text is None else text.encode("utf-8", "replace").lower()


def _repeated(batches):
    """token, n: shingles that several of the texts looked at together have."""
    held, size = [], 0

    def counted():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["token", "n"]
        )

    for batch in batches:
        for data in _texts(batch):
            found = shingles(data, SHINGLE_WORDS)
            held.append(found)
            size += len(found)
            if size >= _COUNTED:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def frequent(docs: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """The most frequent shingles of docs (id, text), at most `most`, in ascending order.

    Counts cover every text; a shingle that no task sees twice at a time stays out, and so
    do all of a class of counts (an eighth of a doubling) that would exceed the number.
    """
    counts = docs.select("text").mapInArrow(_repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = settled(counts.where(F.col("n") >= _LEAST_COUNT).withColumn("class", F.floor(8 * F.log2("n"))))
    classes = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.count("*").alias("n")).collect()}
    least, total = max(classes, default=0) + 1, 0
    for known in sorted(classes, reverse=True):
        total += classes[known]
        if total > most:
            break
        least = known
    top = counts.where(F.col("class") >= least).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def first_size(n: int) -> int:
    """So many first shingles of a set of n hold one of any linked set's."""
    return n - -(-PERCENT * n // 100) + 1


def groups_of(n: int) -> int:
    return min(MOST_GROUPS, 1 << max(4, (-(-n // GROUP_SHINGLES) - 1).bit_length()))


def point_of(found: np.ndarray) -> np.ndarray:
    """The counts of a set's shingles by group, in the smallest type that holds them."""
    size = groups_of(len(found))
    groups = (mixed(found) & np.uint64(size - 1)).astype(np.int64)
    counts = np.bincount(groups, minlength=size)
    return counts.astype(np.min_scalar_type(counts.max()))


def stored(point: bytes, n: int) -> np.ndarray:
    """point_of() a set of n, from its bytes."""
    return np.frombuffer(point, f"u{len(point) // groups_of(n)}").astype(np.int32)


def folded(point: np.ndarray, size: int) -> np.ndarray:
    """The counts for fewer groups."""
    return point.reshape(*point.shape[:-1], -1, size).sum(axis=-2)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    size = min(len(a), len(b))
    return int(np.minimum(folded(a, size), folded(b, size)).sum())


def ordered(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order; those in last (sorted) come last."""
    keys = mixed(found ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)
    if len(last):
        late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
        keys |= late.astype(np.uint64) << np.uint64(63)
    # a tie of keys falls to the shingle itself, because found is sorted
    return found[np.argsort(keys, kind="stable")[: first_size(len(found))]]


def stars_of(found: np.ndarray) -> np.ndarray:
    """Hashes of pairs of MinHash samples of a set."""
    values = (found >> np.uint64(32)).astype(np.uint32)
    samples = np.array([(values * f + f).min() for f in _FACTORS], np.uint64).reshape(STARS, 2)
    return mixed(mixed(samples[:, 0] + _SEEDS[:STARS]) + samples[:, 1]).view(np.int64)


_PRINTS = "id long, doc_id long, n long, same long, stars array<long>, first array<long>, point binary"


def _prints(last):
    def prints(batches):
        for batch in batches:
            rows = []
            for data in _texts(batch):
                found = shingles(data, SHINGLE_WORDS)
                if len(found):
                    same = int(mixed(found).sum().view(np.int64))
                    first = ordered(found, last.value)
                    rows.append((len(found), same, stars_of(found), first.view(np.int64), point_of(found).tobytes()))
                else:
                    rows.append((0, None, None, None, None))
            n, same, stars, first, point = zip(*rows) if rows else [()] * 5
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.int64()),
                    pa.array(stars, longs), pa.array(first, longs), pa.array(point, pa.binary()),
                ],
                names=["id", "doc_id", "n", "same", "stars", "first", "point"],
            )

    return prints


def _sets(batches):
    for batch in batches:
        for row, data in enumerate(_texts(batch)):
            found = shingles(data, SHINGLE_WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(row, 1),
                    pa.array([found.view(np.int64)], pa.list_(pa.int64())),
                ],
                names=["id", "found"],
            )


def _enough(overlap, sizes):
    return (100 + PERCENT) * overlap >= PERCENT * sizes


def _near_points(batches):
    """Pairs (a, b) whose points allow a link."""
    for batch in batches:
        points = [zip(*(batch.column(f"{c}_{s}").to_pylist() for c in ("n", "point"))) for s in "ab"]
        kept = [
            _enough(overlap_bound(stored(p, n), stored(q, m)), n + m)
            for (n, p), (m, q) in zip(*points)
        ]
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _paired(table: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        held = table.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(held, side)
    return pairs


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different ids whose full sets reach the threshold."""
    pairs = settled(pairs.distinct())
    ids = settled(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    own = docs.select("id", "text").join(sent(ids, ids.count(), SENT_IDS), "id", "left_semi")
    sets = settled(own.mapInArrow(_sets, "id long, found array<long>"))
    common = F.size(F.array_intersect("found_a", "found_b"))
    enough = _enough(common, F.size("found_a") + F.size("found_b"))
    return _paired(sets, pairs, "found").where(enough).select("a", "b").distinct()


# The tree of a bucket. Every bucket's part in a task is a root; smaller ones are finished
# in the task that reads them.


class _Box:
    """What the members of a leaf, node or root have at most and at least."""

    def __init__(self, boxes: list[_Box]) -> None:
        self.low = min(b.low for b in boxes)
        self.high = max(b.high for b in boxes)
        self.left = max(b.left for b in boxes)
        roots = {r for b in boxes for r in b.roots}
        #: The group if there is only one, else nothing.
        self.roots = roots if len(roots) == 1 else {None}
        size = min(len(b.top) for b in boxes)
        self.top = np.max([folded(b.top, size) for b in boxes], axis=0)


class _Point(_Box):
    def __init__(self, row: dict) -> None:
        self.id, self.low, self.high, self.left = row["id"], row["n"], row["n"], row["left"]
        self.roots, self.top = {row["root"]}, stored(row["point"], row["n"])


class _Leaf(_Box):
    def __init__(self, points: list[_Point]) -> None:
        super().__init__(points)
        self.ids = np.array([p.id for p in points])
        self.n = np.array([p.low for p in points])
        self.lefts = np.array([p.left for p in points])
        self.owners = np.array([next(iter(p.roots)) for p in points])
        self.points = np.array([folded(p.top, len(self.top)) for p in points], np.int32)


def _may_link(a, b) -> bool:
    """Whether some member of one box can be linked to a member of the other."""
    if a.roots == b.roots != {None}:
        return False
    smaller, larger = sorted((a, b), key=lambda x: x.low)
    if 100 * smaller.high < PERCENT * larger.low:
        return False
    overlap = min(overlap_bound(a.top, b.top), a.left, b.left, a.high, b.high)
    # sizes between the bounds: the smallest possible sum is that of the lower ends
    return _enough(overlap, a.low + b.low)


def _point_pairs(a: _Leaf, b: _Leaf) -> list[tuple[int, int]]:
    """Pairs of ids, the smaller first, whose bounds allow a link between groups."""
    size = min(a.points.shape[1], b.points.shape[1])
    left, right = folded(a.points, size), folded(b.points, size)
    found = []
    for at, point in enumerate(left):
        overlap = np.minimum(point, right).sum(axis=1)
        overlap = np.minimum(overlap, np.minimum(a.lefts[at], b.lefts))
        fits = _enough(overlap, a.n[at] + b.n) & (a.owners[at] != b.owners)
        if a is b:
            fits[: at + 1] = False
        found += [(min(x, y), max(x, y)) for x, y in ((int(a.ids[at]), int(y)) for y in b.ids[fits])]
    return found


_MEMBER = ["bucket", "n", "id", "root", "left", "point"]
_NODE = (
    "a long, b long, bucket long, level int, node long, parent long, low long, high long, left long, "
    "owner long, top binary, ids array<long>, n array<long>, lefts array<long>, owners array<long>, points binary"
)
_NODE_SCHEMA = pa.schema([
    *((c, pa.int64()) for c in ("a", "b", "bucket")), ("level", pa.int32()),
    *((c, pa.int64()) for c in ("node", "parent", "low", "high", "left", "owner")), ("top", pa.binary()),
    *((c, pa.list_(pa.int64())) for c in ("ids", "n", "lefts", "owners")), ("points", pa.binary()),
])


def _box_row(box: _Box, bucket: int, level: int, node: int, parent: int | None) -> dict:
    return {
        "bucket": bucket, "level": level, "node": node, "parent": parent, "low": box.low, "high": box.high,
        "left": box.left, "owner": next(iter(box.roots)), "top": box.top.astype(np.int32).tobytes(),
    }


def _leaf_row(leaf: _Leaf, bucket: int, node: int, parent: int) -> dict:
    return _box_row(leaf, bucket, 0, node, parent) | {
        "ids": leaf.ids.tolist(), "n": leaf.n.tolist(), "lefts": leaf.lefts.tolist(),
        "owners": leaf.owners.tolist(), "points": leaf.points.astype(np.int32).tobytes(),
    }


def _box_of(row: dict, side: str) -> _Box:
    box = _Box.__new__(_Leaf)
    for c in ("low", "high", "left"):
        setattr(box, c, row[f"{c}_{side}"])
    box.roots = {row[f"owner_{side}"]}
    box.top = np.frombuffer(row[f"top_{side}"], np.int32)
    if f"ids_{side}" in row:
        box.ids, box.n, box.lefts, box.owners = (np.array(row[f"{c}_{side}"]) for c in ("ids", "n", "lefts", "owners"))
        box.points = np.frombuffer(row[f"points_{side}"], np.int32).reshape(len(box.ids), -1)
    return box


def _trees(leaf_size: int, fan: int):
    """A function for mapInArrow from ordered members to pairs (small buckets) and tree nodes."""

    def rows(batches):
        bucket, held, leaves, nodes, part, made = None, [], [], [], 0, 0
        whole = False  # whether the bucket began in this part

        def number() -> int:
            nonlocal made
            made += 1
            return part << 40 | made

        def closed_node():
            own = number()
            nodes.append((own, _Box(leaves)))
            for leaf in leaves:
                yield _leaf_row(leaf, bucket, number(), own)
            leaves.clear()

        def closed_bucket(ended: bool):
            if held:
                leaves.append(_Leaf(held))
            if whole and ended and not nodes and len(leaves) == 1:
                yield from ({"a": a, "b": b} for a, b in _point_pairs(leaves[0], leaves[0]))
            elif leaves or nodes:
                if leaves:
                    yield from closed_node()
                root = number()
                for own, box in nodes:
                    yield _box_row(box, bucket, 1, own, root)
                yield _box_row(_Box([box for _, box in nodes]), bucket, 2, root, None)
            held.clear(), leaves.clear(), nodes.clear()

        for batch in batches:
            parts = batch.column("part")
            for at, row in enumerate(batch.select(_MEMBER).to_pylist()):
                if row["bucket"] != bucket:
                    if bucket is not None:
                        yield from closed_bucket(True)
                    whole, bucket, part = bucket is not None, row["bucket"], parts[at].as_py()
                elif len(held) == leaf_size:
                    leaves.append(_Leaf(held))
                    held.clear()
                    if len(leaves) == fan:
                        yield from closed_node()
                held.append(_Point(row))
        if bucket is not None:
            yield from closed_bucket(False)

    def trees(batches):
        found = rows(batches)
        while held := [row for _, row in zip(range(256), found)]:
            yield pa.RecordBatch.from_pylist(held, schema=_NODE_SCHEMA)

    return trees


_BOX = ("node", "low", "high", "left", "owner", "top")
_HELD = ("ids", "n", "lefts", "owners", "points")


def _sides(left: DataFrame, right: DataFrame, on, columns) -> DataFrame:
    a = left.select(*on, *[F.col(c).alias(f"{c}_a") for c in columns])
    b = right.select(*on, *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, list(on)).where("node_a <= node_b")


def _boxes_kept(batches):
    for batch in batches:
        rows = batch.to_pylist()
        kept = [_may_link(_box_of(r, "a"), _box_of(r, "b")) for r in rows]
        yield batch.select(["node_a", "node_b"]).filter(pa.array(kept, pa.bool_()))


def _leaves_kept(batches):
    for batch in batches:
        for row in batch.to_pylist():
            a, b = _box_of(row, "a"), _box_of(row, "b")
            if row["node_a"] == row["node_b"]:
                found = _point_pairs(a, a)
            else:
                found = _point_pairs(a, b) if _may_link(a, b) else []
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def tree_pairs(members: DataFrame, leaf_size: int = LEAF, fan: int = FAN) -> DataFrame:
    """Pairs (a, b) of members (bucket, n, id, root, left, point) of a bucket that may be linked.

    Pairs of one root are left out; each pair is named for every bucket that shows it.
    """
    order = ("bucket", "n", "id")
    rows = members.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().cast("long").alias("part"), *_MEMBER)
    found = settled(rows.mapInArrow(_trees(leaf_size, fan), _NODE))
    pairs = found.where("a is not null").select("a", "b")
    nodes = found.where("a is null")
    tops = nodes.where("level = 2")
    kept = settled(
        _sides(tops, tops, ["bucket"], _BOX).drop("bucket").mapInArrow(_boxes_kept, "node_a long, node_b long")
    )
    for level, columns in ((1, _BOX), (0, (*_BOX, *_HELD))):
        held = nodes.where(f"level = {level}").select("parent", *columns)
        below = kept
        for side in ("a", "b"):
            below = below.join(
                held.select(F.col("parent").alias(f"node_{side}"), *[F.col(c).alias(f"{c}_{side}x") for c in columns]),
                f"node_{side}",
            )
        # a pair of a box with itself has its members' pairs once
        below = below.where("node_a < node_b or node_ax <= node_bx").drop("node_a", "node_b")
        below = below.withColumnsRenamed({c: c[:-1] for c in below.columns})
        if level:
            kept = settled(below.mapInArrow(_boxes_kept, "node_a long, node_b long"))
        else:
            pairs = pairs.union(below.mapInArrow(_leaves_kept, "a long, b long"))
    return pairs


def joined(docs: DataFrame, most: int = FREQUENT) -> DataFrame:
    """id, doc_id, n_shingles, root (the smallest id of the component) for every row."""
    own = identified(docs)
    last = own.sparkSession.sparkContext.broadcast(frequent(own, most))
    prints = settled(own.mapInArrow(_prints(last), _PRINTS))
    last.unpersist()
    worded = prints.where("same is not null")
    classes = settled(worded.groupBy("same", "n").agg(F.min("id").alias("node")))
    # rows that repeat an id are one document
    several = worded.groupBy("id").agg(F.min("same").alias("low"), F.max("same").alias("high"))
    several = several.where("low < high").select("id")
    again = worded.join(several, "id").join(classes, ["same", "n"]).where("id <> node")
    again = settled(again.select(F.col("node").alias("a"), F.col("id").alias("b")).distinct())
    node = classes.select(F.col("node").alias("id"), "same", "n")
    nodes = settled(worded.join(node, ["id", "same", "n"], "left_semi").drop("doc_id", "same"))

    stars = nodes.select("id", F.explode("stars").alias("bucket"))
    pivots = stars.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").drop("z")
    near = stars.join(pivots, "bucket").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    near = _paired(nodes, near, "n", "point").mapInArrow(_near_points, "a long, b long")
    links = settled(_verified(own, near).union(again))
    roots = components(links)

    owned = nodes.join(roots.withColumnRenamed("root", "other"), "id", "left")
    owned = owned.withColumn("root", F.coalesce("other", "id")).drop("other")
    places = owned.select("id", "n", "root", F.posexplode("first").alias("place", "bucket"))
    # of two linked sets the smaller one has the first common shingle so far in front
    near = (100 + PERCENT) * (F.col("n") - F.col("place")) >= 2 * PERCENT * F.col("n")
    shared = places.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max(near).alias("near")
    )
    shared = shared.where("low < high and near").select("bucket")
    members = places.join(shared, "bucket").join(owned.select("id", "n", "point"), ["id", "n"])
    members = members.withColumn("left", F.col("n") - F.col("place"))
    more = settled(_verified(own, tree_pairs(members.select(*_MEMBER))))
    if not more.isEmpty():
        roots = components(links.union(more))

    named = classes.join(roots.withColumnRenamed("id", "node"), "node", "left").select(
        "same", "n", F.coalesce("root", "node").alias("root")
    )
    return (
        prints.select("id", "doc_id", "n", "same")
        .join(named, ["same", "n"], "left")
        .select("id", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("root"))
    )


def ngram_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    * Documents with 100 * common shingles >= 85 * all shingles are linked; a component is
      what links lead to, named by its smallest doc_id.
    * Null or empty texts and texts without words have no shingles and are linked with
      nothing. Fewer than four words are one shingle. Texts are used whole.
    * Rows that repeat a doc_id count as one document that has the links of all of them.
    * A null doc_id takes part through its text; a component of such rows only has a null
      component_id. Ids are below 2**62. Other columns are not looked at. No rows give no
      rows.
    """
    component = F.when(F.col("root") < NO_ID, F.col("root"))
    return joined(docs).select("doc_id", "n_shingles", component.alias("component_id"))
