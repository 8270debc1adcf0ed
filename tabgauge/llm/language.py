"""Language identification by compression against one dictionary per language.

A language's dictionary is raw text of a bounded sample of its labelled documents. A text
is compressed, whole, block by block, with zstandard and each language's dictionary; the
language whose dictionary gives the fewest bytes is chosen. The sample is the documents
with the smallest hash in each of SAMPLE hash buckets per language, so it spreads over the
corpus and does not depend on its layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled
from tabgauge.llm.documents import sent

#: Sampled documents per language, and characters taken from the middle of each.
SAMPLE = 256
SAMPLE_CHARS = 400
#: Bytes of a language's dictionary; what is sent to the executors is this per language.
DICTIONARY = 110 << 10
#: Rows (some 40 bytes each) that are sent to all executors rather than shuffled.
SENT_ROWS = 1_000_000
#: Languages whose dictionaries are held at once; more are compared in groups of so many.
LANGUAGES = 256
#: Bytes compressed at once, so that the dictionary counts throughout a long text.
BLOCK = 2 << 10
LEVEL = 12
#: Bytes of texts that are compressed with one dictionary before the next one has its turn,
#: so that a dictionary's tables (some 1.6 MB) stay in the processor's cache meanwhile.
TURN = 512 << 10
#: Parts of the best size by which the second best must exceed it to be trusted.
MARGIN = 0.01
NONE = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 0 modulo 5."""
    value = F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8"))
    return F.coalesce(value % 5 == 0, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """lang, place, n, text: for each language the documents that its dictionary is made of.

    n is the number of documents that the sampled one stands for.
    """
    learned = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    learned = learned.where(F.col("text").rlike(r"\p{L}"))
    place = F.xxhash64("doc_id")
    marked = learned.select("lang", "text", place.alias("place"))
    chosen = (
        marked.groupBy("lang", F.pmod("place", F.lit(SAMPLE)).alias("bucket"))
        .agg(F.min("place").alias("place"), F.count("*").alias("n"))
        .select("lang", "place", "n")
    )
    start = F.greatest(F.lit(1), (F.length("text") - SAMPLE_CHARS) / 2).cast("int")
    # at most SAMPLE rows a language: sent to the texts, so that no text is shuffled
    chosen = settled(chosen)
    return marked.join(sent(chosen, chosen.count(), SENT_ROWS), ["lang", "place"]).select(
        "lang", "place", "n", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")
    )


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Language to raw dictionary, the most frequent language first.

    At most SAMPLE texts of SAMPLE_CHARS characters a language reach the driver, but for
    repeated rows, of which the driver keeps one.
    """
    texts: dict[str, dict[int, tuple[str, int]]] = {}
    for row in sample(docs).distinct().toLocalIterator():
        own = texts.setdefault(row.lang, {})
        own[row.place] = max(own.get(row.place, ("", 0)), (row.text, row.n))
    frequency = {lang: sum(n for _, n in own.values()) for lang, own in texts.items()}
    found = {}
    for lang in sorted(texts, key=lambda known: (-frequency[known], known)):
        own = texts[lang]
        # each sample has its share of the bytes, so that all are in it in every script
        share = DICTIONARY // len(own) - 1
        parts = (own[place][0].lower().encode("utf-8", "replace")[:share] for place in sorted(own))
        found[lang] = b"\n".join(part.decode("utf-8", "ignore").encode() for part in parts)
    return found


class Sizes:
    """Compressed sizes of texts, one per language."""

    def __init__(self, found: dict[str, bytes]) -> None:
        self.langs = list(found)
        self.compressors = []
        for data in found.values():
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )

    def of(self, text: str) -> np.ndarray:
        return self.of_all([_encoded(text)])[0]

    def of_all(self, texts: list[bytes]) -> np.ndarray:
        """One row per encoded text, one column per language."""
        blocks = [[data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] for data in texts]
        sizes = [[sum(len(c(b)) for b in own) for own in blocks] for c in self.compressors]
        return np.array(sizes, np.int64).T


def _encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _turns(texts: list[str | None]) -> Iterator[dict[int, bytes]]:
    """Place to encoded text, for those with a letter, some TURN bytes at once."""
    held, size = {}, 0
    for place, text in enumerate(texts):
        if _has_letter(text):
            held[place] = _encoded(text)
            size += len(held[place])
        if size >= TURN:
            yield held
            held, size = {}, 0
    if held:
        yield held


def decided(sizes: np.ndarray, langs: list[str]) -> tuple[str, float, bool]:
    """The language of the smallest size, a score from 0 to 1, and whether the margin is wide.

    Ties go to the first, the most frequent language. The score is 1 where nothing else comes near.
    """
    order = np.argsort(sizes, kind="stable")
    best = int(sizes[order[0]])
    margin = (int(sizes[order[1]]) - best) / max(1, best) if len(order) > 1 else 1.0
    return langs[order[0]], min(1.0, margin), margin >= MARGIN


_PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, confident boolean"


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _predicted(found):
    """A function for mapInArrow from (doc_id, held_out, text) to predictions."""

    def predicted(batches):
        groups = [
            Sizes(dict(list(found.value.items())[i : i + LANGUAGES]))
            for i in range(0, len(found.value), LANGUAGES)
        ]
        langs = list(found.value)
        for batch in batches:
            rows = [(NONE, 0.0, False)] * len(batch)
            for turn in _turns(batch.column("text").to_pylist() if langs else []):
                sizes = np.concatenate([g.of_all(list(turn.values())) for g in groups], axis=1)
                for place, own in zip(turn, sizes):
                    rows[place] = decided(own, langs)
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.float64()),
                    pa.array(columns[2], pa.bool_()),
                ],
                names=[c.split()[0] for c in _PREDICTED.split(", ")],
            )

    return predicted


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, confident for every row of docs.

    * Null texts and texts without a letter are `und` with score 0, and so is every text
      where no labelled document is there to learn from.
    * confident is false where the margin between the two smallest sizes is narrow; the
      best language is named all the same.
    * Null ids are never learned from and not held out; repeated rows are judged each.
      Only text, id and lang are looked at, lang only to learn.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    found = own.sparkSession.sparkContext.broadcast(dictionaries(own))
    return own.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        _predicted(found), _PREDICTED
    )
