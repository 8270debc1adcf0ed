"""Token ids of documents in chunks of bit planes, with an index of chunks.

Documents are ordered by doc_id over range partitions, encoded whole, ended with an end
id and written in chunks. A chunk holds whole documents; its ids are cut into blocks of a
fixed size. Each block is transposed: plane k holds bit (or byte) k of all ids of the
block, planes that are zero throughout are left out, each other plane is compressed with
zstandard. The files are Parquet, so that any storage Spark reaches will do: one row per
chunk with its planes, and the chunk index (where each chunk starts, and the ids and
lengths of its documents), which places every document without looking at planes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import scratch_path
from tabgauge.llm.tokens import encoder
from tabgauge.llm.workers import few_rows, thrifty

TOKENIZER = "word_bpe_49k.json"
END = 2
#: Ids in a block, and the number from which a chunk ends after a document.
BLOCK = 1 << 15
CHUNK = 1 << 18
LEVEL = 3
#: Documents' texts of about so many bytes make a range partition.
PARTITION_BYTES = 32 << 20
#: Rows that a task hands to Python at once.
ROWS = 2000

_CHUNKS = (
    "part int, chunk int, n_ids long, doc_ids array<long>, lengths array<long>, "
    "kind string, widths array<int>, planes array<binary>"
)


def bit_planes(ids: np.ndarray) -> list[bytes]:
    """Bit k of all ids as one string of bits, for each k up to the highest bit set."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits[:, :width].T), axis=1, bitorder="little")
    return [plane.tobytes() for plane in packed]


def from_bit_planes(planes: list[bytes], count: int) -> np.ndarray:
    if not planes:
        return np.zeros(count, np.uint32)
    # as many whole bytes as the planes need, two for most vocabularies
    size = next(n for n in (1, 2, 4) if 8 * n >= len(planes))
    ids = np.zeros(count, f"<u{size}")
    for k, plane in enumerate(planes):
        bits = np.unpackbits(np.frombuffer(plane, np.uint8), count=count, bitorder="little")
        ids |= bits.astype(ids.dtype) << ids.dtype.type(k)
    return ids.astype(np.uint32)


def byte_planes(ids: np.ndarray) -> list[bytes]:
    """Byte k of all ids, for each k up to the highest byte in use."""
    width = (int(ids.max()).bit_length() + 7) // 8 if len(ids) else 0
    split = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [np.ascontiguousarray(split[:, k]).tobytes() for k in range(width)]


def from_byte_planes(planes: list[bytes], count: int) -> np.ndarray:
    split = np.zeros((count, 4), np.uint8)
    for k, plane in enumerate(planes):
        split[:, k] = np.frombuffer(plane, np.uint8)
    return split.reshape(-1).view("<u4").astype(np.uint32)


KINDS = {"bit": (bit_planes, from_bit_planes), "byte": (byte_planes, from_byte_planes)}


def shuffled(ids: np.ndarray, kind: str) -> tuple[list[int], list[bytes]]:
    """The number of planes of each block, and all planes, compressed."""
    split = KINDS[kind][0]
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    widths, planes = [], []
    for start in range(0, len(ids), BLOCK):
        own = split(ids[start : start + BLOCK])
        widths.append(len(own))
        planes += map(compress, own)
    return widths, planes


def unshuffled(widths: list[int], planes: list[bytes], count: int, kind: str) -> np.ndarray:
    join = KINDS[kind][1]
    decompress = zstandard.ZstdDecompressor().decompress
    blocks, used = [], 0
    for at, width in enumerate(widths):
        own = [decompress(p) for p in planes[used : used + width]]
        used += width
        blocks.append(join(own, min(BLOCK, count - at * BLOCK)))
    return np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)


def _chunked(name: str, end: int, kind: str):
    """A function for mapInArrow from ordered (part, doc_id, text) to chunks."""

    @thrifty
    def chunked(batches):
        encode_all = encoder(name).encode_all
        numbers: dict[int, int] = {}
        part, held, size = None, [], 0

        def chunk():
            ids = np.frombuffer(b"".join(data for _, data in held), "<u4")
            widths, planes = shuffled(ids, kind)
            number = numbers.get(part, 0)
            numbers[part] = number + 1
            row = {
                "part": part,
                "chunk": number,
                "n_ids": len(ids),
                "doc_ids": [doc_id for doc_id, _ in held],
                "lengths": [len(data) // 4 for _, data in held],
                "kind": kind,
                "widths": widths,
                "planes": planes,
            }
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "doc_id"))
            for here, doc_id, data in zip(*columns, encode_all(batch.column("text"))):
                if held and (here != part or size >= CHUNK):
                    yield chunk()
                    held, size = [], 0
                part = here
                data += end.to_bytes(4, "little")
                held.append((doc_id, data))
                size += len(data) // 4
        if held:
            yield chunk()

    return chunked


_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("chunk", pa.int32()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("kind", pa.string()),
        ("widths", pa.list_(pa.int32())),
        ("planes", pa.list_(pa.binary())),
    ]
)


def write(
    docs: DataFrame, path: str, name: str = TOKENIZER, end: int = END, kind: str = "bit"
) -> None:
    """Write the ids of docs (doc_id, text) in ascending order of doc_id below path.

    path/chunks holds the planes, path/index the chunk index with the absolute start of
    each chunk. Rows with equal ids are ordered by their texts; null ids come first;
    null texts have the end id only.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    size = own.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    count = max(1, -(-size // PARTITION_BYTES))
    ordered = own.withColumn("same", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(count, "doc_id", "same").sortWithinPartitions("doc_id", "same")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    chunks = ordered.mapInArrow(_chunked(name, end, kind), _CHUNKS)
    with few_rows(docs.sparkSession, ROWS):  # planes are compressed already
        chunks.write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    stored = docs.sparkSession.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    earlier = (
        Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("base") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))
    stored.select("part", "chunk", "n_ids", "doc_ids", "lengths").join(bases, "part").select(
        "part", "chunk", start.alias("start"), "n_ids", "doc_ids", "lengths"
    ).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def _decoded(batches):
    schema = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    for batch in batches:
        for row in batch.to_pylist():
            ids = unshuffled(row["widths"], row["planes"], row["n_ids"], row["kind"])
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            data = ids.astype("<u4").tobytes()
            parts = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array(parts, pa.binary()),
                ],
                names=schema,
            )


def _digested(batches):
    for batch in _decoded(batches):
        yield batch.select(["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids, decoded from the planes."""
    chunks = spark.read.parquet(f"{path}/chunks").drop("doc_ids", "lengths", "n_ids")
    rows = chunks.join(read_index(spark, path), ["part", "chunk"])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if ids:
        return rows.mapInArrow(_decoded, schema + ", ids binary")
    return rows.mapInArrow(_digested, schema)


def written_and_read(docs: DataFrame) -> DataFrame:
    """Write docs to the shared scratch folder and read them back.

    One row per row of docs, also for null or repeated ids; null and empty texts have
    one token, the end id; an empty table gives no rows. Other columns are not looked at.
    """
    path = scratch_path(docs.sparkSession)
    write(docs, path)
    return read(docs.sparkSession, path)
