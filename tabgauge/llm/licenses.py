"""Licence texts in documents, by MinHash bands over overlapping windows.

Words are runs of ASCII letters and digits, in lower case, and other characters; shingles
are three words. Every template belongs to the scale of its length: windows of 1, 4 or 16
shingles, taken from the template at every offset and from documents at a step (1, 1, 4)
that puts at least one window of the document wholly inside an unchanged copy. Bands of
two MinHash samples retrieve templates: windows of a similarity of 0.7 share one of eight
bands with a probability of 0.995, equal windows always.

Retrieved templates are verified exactly, on all shingles of the document: neighbouring
shingles that the template has form a group (gaps of up to a quarter of the template plus
three), and a group that holds PERCENT percent of the template's shingles is a match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.llm.license_texts import TEMPLATES
from tabgauge.llm.words import mixed, windows, word_hashes

SHINGLE = 3
PERCENT = 75
#: Window size in shingles, step in documents, least template size.
SCALES = ((1, 1, 1), (4, 1, 5), (16, 4, 20))
BANDS = 8
ROWS = 2
#: Templates are sent to the executors; more words than this are refused.
TEMPLATE_WORDS = 2_000_000

_random = np.random.default_rng(77)
_FACTORS = (_random.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_OFFSETS = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))[:, None]
_FILTER_BITS = 21
_BLOCK = 1 << 15
_LETTERS = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower()
)


def placed_shingles(text: str | None) -> np.ndarray:
    """The hash of each shingle, in the order of the text."""
    if not text:
        return np.empty(0, np.uint64)
    return windows(word_hashes(text.encode("utf-8", "replace").translate(_LETTERS)), SHINGLE)


def band_keys(shingles: np.ndarray, size: int, step: int) -> np.ndarray:
    """Keys of the bands (rows) of each window (columns) of `size` shingles."""
    if len(shingles) < size:
        return np.empty((BANDS, 0), np.uint64)
    if size == 1:
        return shingles[None, :]
    lowest = (shingles >> np.uint64(32)).astype(np.uint32)[None, :] * _FACTORS
    lowest += _OFFSETS
    reach = 1
    while reach < size:
        lowest = np.minimum(lowest[:, :-reach], lowest[:, reach:])
        reach *= 2
    rows = lowest[:, ::step].astype(np.uint64).reshape(BANDS, ROWS, -1)
    return mixed((rows[:, 0] << np.uint64(32) | rows[:, 1]) ^ _BAND)


class Templates:
    """Band keys of all template windows, and the shingles of each template."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        self.shingles = [np.unique(placed_shingles(texts[name])) for name in self.names]
        if sum(map(len, self.shingles)) > TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {TEMPLATE_WORDS} words")
        self.scales = []
        for at, (size, step, least) in enumerate(SCALES):
            most = SCALES[at + 1][2] if at + 1 < len(SCALES) else 1 << 60
            keys, owners = [], []
            for k, name in enumerate(self.names):
                placed = placed_shingles(texts[name])
                if least <= len(placed) < most:
                    own = np.unique(band_keys(placed, size, 1))
                    keys.append(own)
                    owners.append(np.full(len(own), k))
            if keys:
                every = np.concatenate(keys)
                order = np.argsort(every, kind="stable")
                seen = np.zeros(1 << _FILTER_BITS, bool)
                seen[every >> np.uint64(64 - _FILTER_BITS)] = True
                self.scales.append((size, step, seen, every[order], np.concatenate(owners)[order]))

    def retrieved(self, placed: np.ndarray) -> set[int]:
        """Templates that share a band with some window of the document."""
        found: set[int] = set()
        for size, step, seen, keys, owners in self.scales:
            for start in range(0, max(0, len(placed) - size + 1), _BLOCK):
                wanted = band_keys(placed[start : start + _BLOCK + size - 1], size, step)
                wanted = wanted[seen[wanted >> np.uint64(64 - _FILTER_BITS)]]
                first = np.searchsorted(keys, wanted, side="left")
                last = np.searchsorted(keys, wanted, side="right")
                for a, b in set(zip(first.tolist(), last.tolist())):
                    found.update(owners[a:b].tolist())
        return found

    def matches(self, placed: np.ndarray, template: int) -> list[tuple[int, int, float]]:
        """First word, end word and containment of each group that holds the template."""
        wanted = self.shingles[template]
        hits = np.flatnonzero(np.isin(placed, wanted))
        if not len(hits):
            return []
        gap = len(wanted) // 4 + SHINGLE
        groups = np.split(hits, np.flatnonzero(np.diff(hits) > gap) + 1)
        found = []
        for group in groups:
            held = len(np.unique(placed[group]))
            if 100 * held >= PERCENT * len(wanted):
                found.append((int(group[0]), int(group[-1]) + SHINGLE, held / len(wanted)))
        return found

    def scan(self, text: str | None, every: bool = False) -> list[tuple[int, int, str, float]]:
        """first, end, name, containment of all matches; `every` verifies all templates."""
        placed = placed_shingles(text)
        chosen = range(len(self.names)) if every else self.retrieved(placed)
        return sorted(
            (first, end, self.names[k], share)
            for k in chosen
            for first, end, share in self.matches(placed, k)
        )


_SCANNED = "doc_id long, n_licenses long, licenses string, spans string, matches array<struct<name:string,first:long,last:long,containment:double>>"


def _scanned(templates):
    """A function for mapInArrow from (doc_id, text) to matches."""
    match = pa.struct(
        [("name", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]
    )

    def scanned(batches):
        for batch in batches:
            found = [templates.value.scan(t.as_py()) for t in batch.column("text")]
            names = [sorted({name for _, _, name, _ in rows}) for rows in found]
            spans = [",".join(f"{name}:{a}:{b}" for a, b, name, _ in rows) for rows in found]
            held = [
                [{"name": name, "first": a, "last": b, "containment": share} for a, b, name, share in rows]
                for rows in found
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(n) for n in names], pa.int64()),
                    pa.array([",".join(n) for n in names], pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(held, pa.list_(match)),
                ],
                names=["doc_id", "n_licenses", "licenses", "spans", "matches"],
            )

    return scanned


def licenses(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses, spans, matches for every row of docs (doc_id, text).

    spans lists name:first:last by place, in words, ends exclusive; matches adds the share
    of the template's shingles that is held. Null texts and texts of fewer than three words
    have no match, and a template of fewer than three words never has one. Repeated rows
    and null ids keep their rows; other columns are not looked at; an empty table gives no
    rows. Texts are searched whole.
    """
    templates = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if texts is None else texts))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scanned(templates), _SCANNED)
