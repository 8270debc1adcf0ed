"""Best-two-fit packing of documents into sequences of bounded length.

Documents are encoded once into pieces. Packing needs only how many pieces have each
length, at most as many numbers as a sequence has places, whatever the corpus: the
driver plans patterns of lengths and how often each is used. A pattern is filled
greedily, always with the longest piece that fits; then its smallest piece is replaced
by two unpacked ones that fit the expanded gap more tightly, while there are such.

Pieces of one length are numbered by Spark, in salted groups of bounded size, and the
number of a piece tells its sequence and its place there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled
from tabgauge.llm.tokens import encoder
from tabgauge.llm.workers import thrifty

TOKENIZER = "byte_bpe_50k.json"
END = 0
LENGTH = 2048
#: Pieces of one length are numbered in groups of about so many.
GROUP = 500_000
_LEAST_GROUPS = 64


def _pieces(name: str, end: int, length: int, ids: bool):
    """A function for mapInArrow from (doc_id, text) to pieces."""

    @thrifty
    def cut(batches):
        encode_all = encoder(name).encode_all
        width = 4 * length
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encode_all(batch.column("text"))):
                data += end.to_bytes(4, "little")
                first = len(data) % width or width
                starts = [0, *range(first, len(data), width)]
                for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], len(data)])):
                    part = data[start:stop]
                    row = (doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if ids else row)
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            kept = 6 if ids else 5
            yield pa.RecordBatch.from_arrays(arrays[:kept], names=names[:kept])

    return cut


def pieces(
    docs: DataFrame, name: str = TOKENIZER, end: int = END, length: int = LENGTH, ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids (little-endian, 4 bytes each).

    Each text is encoded whole and ended with the id `end`. Only longer ones are cut;
    the first piece takes what does not fill a sequence.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_pieces(name, end, length, ids), schema + ", ids binary" * ids)


def patterns(counts: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """Lengths packed together, and how many sequences are packed so.

    Every pattern is used until one of its lengths runs out, so that there are no more
    patterns than lengths.
    """
    left = np.zeros(length + 1, np.int64)
    for size, count in counts.items():
        left[size] = count
    found = []
    while left.any():
        packed: list[int] = []
        gap = length

        def take(size: int) -> None:
            packed.append(size)
            left[size] -= 1

        while gap:
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            take(int(fitting[-1]))
            gap -= packed[-1]
        while gap and len(packed) > 1:
            smallest = min(packed)
            pair = _pair(left, gap + smallest)
            if sum(pair) <= smallest:
                break
            packed.remove(smallest)
            left[smallest] += 1
            for size in pair:
                take(size)
            gap += smallest - sum(pair)
        sizes, needs = np.unique(packed, return_counts=True)
        more = int((left[sizes] // needs).min())
        left[sizes] -= more * needs
        found.append((sorted(packed, reverse=True), 1 + more))
    return found


def _pair(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two unpacked lengths with the largest sum that fits; (0, 0) if there are none."""
    sizes = np.flatnonzero(left[: room + 1])
    if not len(sizes):
        return 0, 0
    most = np.minimum(room - sizes, sizes)
    most = np.where((most == sizes) & (left[sizes] < 2), most - 1, most)
    at = np.searchsorted(sizes, most, side="right") - 1
    sums = np.where(at >= 0, sizes + sizes[np.maximum(at, 0)], 0)
    best = int(sums.argmax())
    return (int(sizes[best]), int(sizes[at[best]])) if sums[best] else (0, 0)


class Places:
    """For the number of a piece among those of its length: its sequence and offset."""

    def __init__(self, counts: dict[int, int], length: int = LENGTH) -> None:
        used: dict[int, int] = dict.fromkeys(counts, 0)
        rows = []
        sequence = 0
        for packed, copies in patterns(counts, length):
            offset = 0
            for size in dict.fromkeys(packed):
                times = packed.count(size)
                rows.append((size, used[size], times, sequence, offset))
                used[size] += times * copies
                offset += times * size
            sequence += copies
        self.sequences = sequence
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.keys = (table[:, 0] << 48) | table[:, 1]
        self.first, self.times, self.sequence, self.offset = table[:, 1:].T

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 48) | number, side="right") - 1
        nth = number - self.first[at]
        sequence = self.sequence[at] + nth // self.times[at]
        return sequence, self.offset[at] + nth % self.times[at] * length


def _placed(places):
    """A function for mapInArrow that gives numbered pieces their sequence and offset."""

    @thrifty
    def placed(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = places.value.of(length, number)
            rest = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(sequence), pa.array(offset)],
                names=[*rest, "sequence_id", "offset"],
            )

    return placed


def _numbered(cut: DataFrame, total: int) -> DataFrame:
    """Pieces with their number among those of their length, from 0."""
    groups = max(_LEAST_GROUPS, total // GROUP)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    salted = cut.withColumn("salt", salt)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("nth", F.row_number().over(within) - 1)
        .join(bases, ["length", "salt"])
        .select(*cut.columns, (F.col("base") + F.col("nth")).alias("number"))
    )


def pack(docs: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    * Null and empty texts are one piece that holds only the end id.
    * Rows with equal or null ids are packed each. Other columns are not looked at.
    * An empty table gives no rows. With ids, the pieces carry their ids too.
    """
    cut = settled(pieces(docs, ids=ids))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = cut.sparkSession.sparkContext.broadcast(Places(counts))
    fields = ", ".join(f"{name} {kind}" for name, kind in cut.dtypes)
    return _numbered(cut, sum(counts.values())).mapInArrow(
        _placed(places), fields.replace("bigint", "long") + ", sequence_id long, offset long"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences, from pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda all, p: F.concat(all, p["ids"])).alias("ids")
    )
