"""Token counts that follow edits, from segment trees over pre-tokens.

A tokenizer cuts a text into pre-tokens before it merges bytes, so a text has as many
tokens as its pre-tokens together. A document keeps the length and the token count of
each pre-token in leaves, under a tree of sums of both. An edit descends the tree to the
pre-token before it, cuts anew from there until the cuts fall together with the old ones
again behind the edit, encodes only these pre-tokens, and updates the sums above them.

Whether a pre-token ends depends on at most two characters behind it (the fixed pattern
looks one character ahead of white space), so two characters before the edit are enough
context; behind it, one common cut is.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.llm import secrets
from tabgauge.llm.tokens import encoder

TOKENIZER = "byte_bpe_50k.json"
#: Pre-tokens in a leaf when a tree is built; a leaf that grows to eight times as many
#: has the tree built anew from the numbers it holds.
LEAF = 64
_KNOWN = 400_000
_CUT = regex.compile(public_tokenizers.PATTERN)

EDITS = "array<struct<start:int,end:int,text:string>>"


class _Counts(dict):
    """Pre-token to number of tokens; remembers a bounded number."""

    def __missing__(self, word: str) -> int:
        count = len(encoder(TOKENIZER)._word(word)) // 4
        if len(self) < _KNOWN:
            self[word] = count
        return count


_counts = _Counts()


class Tree:
    """The pre-tokens of one text: leaves of lengths and counts, and sums above them."""

    def __init__(self, text: str, lengths: list[int] | None = None, counts: list[int] | None = None) -> None:
        self.text = text
        self.encoded = 0
        if lengths is None:
            words = _CUT.findall(text)
            lengths, counts = list(map(len, words)), list(map(_counts.__getitem__, words))
        self._build(lengths, counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        starts = range(0, len(lengths), LEAF)
        self.lengths = [lengths[i : i + LEAF] for i in starts] or [[]]
        self.counts = [counts[i : i + LEAF] for i in starts] or [[]]
        self.size = 1 << (len(self.lengths) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        for k, (a, b) in enumerate(zip(self.lengths, self.counts)):
            self.sums[self.size + k] = sum(a), sum(b)
        at = self.size
        while at > 1:
            below = self.sums[at : 2 * at]
            at //= 2
            self.sums[at : 2 * at] = below[::2] + below[1::2]

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def state(self) -> tuple[list[int], list[int]]:
        """Lengths and counts of all pre-tokens, to keep and to build the tree from again."""
        return [x for leaf in self.lengths for x in leaf], [x for leaf in self.counts for x in leaf]

    def _locate(self, place: int) -> tuple[int, int, int]:
        """Leaf, index and start of the pre-token that holds the character at place."""
        at, start = 1, 0
        while at < self.size:
            at *= 2
            left = int(self.sums[at, 0])
            if place >= start + left and self.sums[at + 1, 0] > 0:
                start += left
                at += 1
        leaf = at - self.size
        for index, length in enumerate(self.lengths[leaf]):
            if place < start + length:
                return leaf, index, start
            start += length
        return leaf, len(self.lengths[leaf]), start

    def _update(self, leaf: int) -> None:
        at = self.size + leaf
        self.sums[at] = sum(self.lengths[leaf]), sum(self.counts[leaf])
        while at > 1:
            at //= 2
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply edits (start, end, new text), ordered and apart, to the text as it is."""
        parts, last = [], 0
        for start, end, new in edits:
            parts += [self.text[last:start], new]
            last = end
        text = "".join([*parts, self.text[last:]])
        shift, k = 0, 0
        while k < len(edits):
            start, end, new = edits[k]
            k += 1
            # all places are those of the text with the edits before this one applied
            first, index, place = self._locate(max(0, start + shift - 2))
            behind, grown = end + shift, len(new) - (end - start)
            leaf, nth, old, at = first, index, place, place
            words: list[str] = []
            while True:
                here = at - grown
                if here >= behind:
                    if k < len(edits) and edits[k][0] + shift - 2 < here:  # the next one is near
                        behind = edits[k][1] + shift
                        grown += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                        k += 1
                        continue
                    while old < here:
                        while nth >= len(self.lengths[leaf]):
                            leaf, nth = leaf + 1, 0
                        old += self.lengths[leaf][nth]
                        nth += 1
                    if old == here:
                        break
                word = _CUT.match(text, at).group()
                words.append(word)
                at += len(word)
            self._replace(first, index, leaf, nth, words)
            shift += grown
        self.text = text

    def _replace(self, first: int, index: int, leaf: int, nth: int, words: list[str]) -> None:
        """Put words in place of the pre-tokens from (first, index) up to (leaf, nth)."""
        self.encoded += len(words)
        new = list(map(len, words)), list(map(_counts.__getitem__, words))
        for values, added in zip((self.lengths, self.counts), new):
            if leaf == first:
                values[first][index:nth] = added
            else:
                values[first][index:] = added
                for between in range(first + 1, leaf):
                    values[between] = []
                values[leaf] = values[leaf][nth:]
        if len(self.lengths[first]) >= 8 * LEAF:
            self._build(*self.state())
        else:
            for changed in range(first, leaf + 1):
                self._update(changed)


def ordered(edits, length: int) -> list[tuple[int, int, str]]:
    """Edits within the text, by place; of overlapping ones the first counts, extended."""
    found: list[tuple[int, int, str]] = []
    clipped = (
        (min(max(e["start"] or 0, 0), length), min(max(e["end"] or 0, e["start"] or 0, 0), length), e["text"] or "")
        for e in edits or ()
        if e is not None
    )
    for start, end, text in sorted(clipped, key=lambda e: e[:2]):
        if found and start < found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]), found[-1][2])
        else:
            found.append((start, end, text))
    return found


_COUNTED = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_reencoded long"


def _counted(batches):
    for batch in batches:
        rows = []
        for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
            tree = Tree(text or "")
            before, changes = tree.n_tokens, ordered(edits, len(text or ""))
            tree.apply(changes)
            rows.append((before, len(changes), tree.n_tokens, tree.encoded))
        columns = list(zip(*rows)) if rows else [()] * 4
        names = [c.split()[0] for c in _COUNTED.split(", ")]
        arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def recounted(docs: DataFrame, edits: Column) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_reencoded for every row of docs.

    edits is a column of type EDITS, in code points of the row's text, ends exclusive.
    Null edits are none; null texts are empty; places outside the text are moved to its
    ends; edits that overlap become one, with the text of the first. Repeated rows and
    null ids keep their rows; an empty table gives no rows.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        edits.cast(EDITS).alias("edits"),
    )
    return own.mapInArrow(_counted, _COUNTED)


def counts_after_redaction(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Token counts of documents before and after their secrets are redacted."""
    found = secrets.with_spans(docs.select("doc_id", "text"))
    edits = F.transform(
        "_spans",
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark).alias("text")),
    )
    return recounted(found, edits)


_KEPT = "doc_id long, text string, lengths array<int>, counts array<int>"


def _built(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        yield _kept(batch.column("doc_id"), [Tree(t) for t in texts])


def _kept(ids, trees: list[Tree]) -> pa.RecordBatch:
    states = [t.state() for t in trees]
    numbers = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([t.text for t in trees], pa.string()),
            pa.array([a for a, _ in states], numbers),
            pa.array([b for _, b in states], numbers),
        ],
        names=["doc_id", "text", "lengths", "counts"],
    )


def _edited(batches):
    for batch in batches:
        trees = []
        for row in batch.select(["text", "lengths", "counts", "edits"]).to_pylist():
            tree = Tree(row["text"], row["lengths"], row["counts"])
            tree.apply(ordered(row["edits"], len(tree.text)))
            trees.append(tree)
        yield _kept(batch.column("doc_id"), trees)


def states(docs: DataFrame) -> DataFrame:
    """doc_id, text, lengths, counts: what to store so that later edits need no full encoding."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_built, _KEPT)


def edited(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Stored states after edits (doc_id, start, end, text), any number per document."""
    grouped = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "text")).cast(EDITS).alias("edits"))
    return stored.join(grouped, "doc_id", "left").mapInArrow(_edited, _KEPT)
