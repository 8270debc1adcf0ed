"""Conversation repair with Four-Russians block tables.

A conversation should read system?, (user, assistant)+ or be empty. Each row is a symbol:
the initial of its role, and whether its text is cut off. Rows are kept, given another
role or deleted, and empty rows inserted, at least cost. From the right, the costs to
finish from each of the four states of that pattern form a vector; less its least entry
it is one of a few vectors, so the step over one symbol, or over a block of symbols, is a
table from vector to vector. The tables of all blocks of a fixed length are made once:

1. A conversation's blocks are processed by lookup, from the last to the first.
2. For the edits, each block is expanded backward into its vectors, and followed forward
   with the ASCII-least edit among those that keep to the costs, so that ties are safe.

Rows that must go cost the same from every state; they never enter a block.

A step over a run of rows is a table as well, so long conversations are cut into chunks
that tasks turn into tables; these are chained from the right (vectors) and from the left
(states), and then all chunks are followed at once. Conversations that lie within one
chunk are finished where they are read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled

#: Costs of the edits, and of leaving a cut off text.
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: Symbols of a block.
BLOCK = 4
#: Rows, or characters of text, from which a long conversation's chunk ends.
CHUNK_ROWS = 1024
CHUNK_CHARS = 1 << 20

_INITIALS = "sua"
#: States: nothing yet, after system, after user, after assistant.
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: From each state the role that may be inserted or given, and where that leads.
_GIVEN = ("user", "user", "assistant", "user")
_THEN = (2, 2, 3, 2)
_SYMBOLS = 2 * (len(_INITIALS) + 1)
_NEVER = 1 << 20


def symbol(role: str, cut_off: bool) -> int:
    place = _INITIALS.find(role[0]) if role else -1
    return 2 * (place if place >= 0 else len(_INITIALS)) + cut_off


class Tables:
    """The vectors there are, and for symbols and blocks where each vector leads."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.end = self._known((0, 2 * INSERT, INSERT, 0))
        steps = []
        for vector in self.vectors:  # grows until no step leads to a new vector
            found = [self._before(vector, s) for s in range(_SYMBOLS)]
            steps.append([(self._known(tuple(c - min(v) for c in v)), min(v)) for v in found])
        one = np.array(steps, np.int64).transpose(2, 1, 0)
        self.to, self.cost = self._blocks(one[0].astype(np.uint8), one[1])
        self.one_to, self.one_cost = one[0].tolist(), one[1].tolist()
        self.edits = [
            [[self._edit(v, s, q) for q in range(4)] for s in range(_SYMBOLS)] for v in self.vectors
        ]
        self.expanded = functools.lru_cache(100_000)(self._expanded)

    def _known(self, vector: tuple[int, ...]) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    @staticmethod
    def _choices(after, s: int, state: int):
        """Edit, cost to finish and next state, for the edits that use up a symbol."""
        more = CUT_OFF * (s % 2)
        yield "D", DELETE + after[state], state
        kept = _NEXT[_INITIALS[s // 2]][state] if s // 2 < len(_INITIALS) else None
        if kept is not None:
            yield "K", more + after[kept], kept
        yield "R", REROLE + more + after[_THEN[state]], _THEN[state]

    def _before(self, after, s: int) -> list[int]:
        """Costs to finish from each state, before a symbol."""
        costs = [min(cost for _, cost, _ in self._choices(after, s, q)) for q in range(4)]
        for _ in range(4):
            costs = [min(c, INSERT + costs[_THEN[q]]) for q, c in enumerate(costs)]
        return costs

    def _edit(self, after, s: int, state: int) -> tuple[str, int]:
        """The ASCII-least edits up to and with the one that uses up the symbol."""
        costs, edits = self._before(after, s), ""
        while True:
            best = {e: q for e, cost, q in self._choices(after, s, state) if cost == costs[state]}
            if "D" not in best and INSERT + costs[_THEN[state]] == costs[state]:
                edits, state = edits + "I", _THEN[state]
                continue
            edit = min(best)
            return edits + edit, best[edit]

    @staticmethod
    def _blocks(to: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block (a number in base _SYMBOLS, first symbol leading) and vector."""
        all_to, all_cost = to, cost
        for _ in range(BLOCK - 1):
            led = to[:, all_to]
            all_cost = (all_cost[None] + cost[:, all_to]).reshape(-1, to.shape[1])
            all_to = led.reshape(-1, to.shape[1])
        return all_to, all_cost

    def _expanded(self, symbols: tuple[int, ...], vector: int, state: int) -> tuple[tuple[str, ...], int]:
        """The edits of each symbol of a block, and the state after it."""
        after = [vector]
        for s in symbols[:0:-1]:
            after.append(self.one_to[s][after[-1]])
        found = []
        for s, v in zip(symbols, reversed(after)):
            edit, state = self.edits[v][s][state]
            found.append(edit)
        return tuple(found), state

    def _split(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Numbers of the whole blocks, and the symbols after them."""
        whole = len(symbols) // BLOCK * BLOCK
        powers = _SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        return (np.array(symbols[:whole], np.int64).reshape(-1, BLOCK) @ powers).tolist(), symbols[whole:]

    def back(self, symbols: list[int], vector: int) -> tuple[list[int], int, int]:
        """The vectors after each block (and after the rest), the first vector, the cost."""
        blocks, rest = self._split(symbols)
        after, cost = [vector], 0
        for s in reversed(rest):
            cost += self.one_cost[s][vector]
            vector = self.one_to[s][vector]
        for block in reversed(blocks):
            after.append(vector)
            cost += int(self.cost[block, vector])
            vector = int(self.to[block, vector])
        return after[::-1], vector, cost

    def table(self, symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """back() for all vectors at once: where each leads, and at which cost."""
        blocks, rest = self._split(symbols)
        to = np.arange(len(self.vectors))
        cost = np.zeros(len(to), np.int64)
        for s in reversed(rest):
            cost += np.array(self.one_cost[s])[to]
            to = np.array(self.one_to[s])[to]
        for block in reversed(blocks):
            cost += self.cost[block, to]
            to = self.to[block, to]
        return to, cost

    def forward(self, symbols: list[int], vector: int, state: int) -> tuple[list[str], int]:
        """The edits of each symbol, with the vector after the last one, and the last state."""
        after, _, _ = self.back(symbols, vector)
        found: list[str] = []
        whole = len(symbols) // BLOCK * BLOCK
        starts = [*range(0, whole, BLOCK), *([whole] if whole < len(symbols) else [])]
        for start, v in zip(starts, after):
            edits, state = self.expanded(tuple(symbols[start : start + BLOCK]), v, state)
            found += edits
        return found, state


@functools.cache
def tables() -> Tables:
    return Tables()


def finish(state: int) -> list[str]:
    """Roles of the rows that have to follow the last row."""
    return {1: ["user", "assistant"], 2: ["assistant"]}.get(state, [])


class _Chunk:
    """Consecutive rows of one conversation, in order."""

    def __init__(self, conv: str | None) -> None:
        self.conv = conv
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.copies: list[int] = []
        self.symbols: list[int] = []  # -1 for rows that must go
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn, role, text, copies, blank, again, cut_off) -> None:
        if not copies:
            return
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (not again)
            self.truncated += cut_off and not again
        if self.roles:
            self.illegal += _illegal(self.roles[-1], role)
        self.illegal += (copies - 1) * _illegal(role, role)
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        gone = blank or again
        self.roles.append(role)
        self.texts.append("" if gone else text)
        self.copies.append(copies)
        self.symbols.append(-1 if gone else symbol(role, cut_off))
        self.chars += len(self.texts[-1])

    def known(self) -> dict:
        return {
            "conv": self.conv, "low": self.low, "high": self.high, "turns": self.turns,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal,
        }

    def live(self) -> list[int]:
        return [s for s in self.symbols if s >= 0]

    def gone(self) -> int:
        return sum(n - (s >= 0) for n, s in zip(self.copies, self.symbols))


def _illegal(left: str, right: str) -> bool:
    return left[:1] + right[:1] not in ("su", "ua", "au")


def _followed(symbols, roles, texts, copies, vector: int, state: int):
    """The edits as one string, the repaired (role, text) rows, and the state after them."""
    edits, after = tables().forward([s for s in symbols if s >= 0], vector, state)
    edits = iter(edits)
    audit, rows = [], []
    for s, role, text, n in zip(symbols, roles, texts, copies):
        if s >= 0:
            own = next(edits)
            audit.append(own)
            for edit in own:
                if edit == "K":
                    rows.append((role, text))
                    state = _NEXT[_INITIALS[s // 2]][state]
                elif edit != "D":
                    rows.append((_GIVEN[state], text if edit == "R" else ""))
                    state = _THEN[state]
            n -= 1
        audit.append("D" * n)
    assert state == after
    return "".join(audit), rows, state


def _joined(rows) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode("utf-8", "replace")


_KNOWN = "conv string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"
_READ = (
    f"{_KNOWN}, part int, no int, first string, last string, gone long, symbols array<int>, roles array<string>, "
    "texts array<string>, copies array<long>, to array<int>, costs array<long>, "
    "cost long, audit string, digest string, repaired array<struct<role: string, text: string>>"
)
_TEXTS = pa.list_(pa.string())
_KNOWN_TYPES = [("conv", pa.string()), *((c, pa.int64()) for c in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal"))]
_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_DONE = [("cost", pa.int64()), ("audit", pa.string()), ("digest", pa.string()), ("repaired", _REPAIRED)]
_READ_SCHEMA = pa.schema([
    *_KNOWN_TYPES, ("part", pa.int32()), ("no", pa.int32()), ("first", pa.string()), ("last", pa.string()),
    ("gone", pa.int64()), ("symbols", pa.list_(pa.int32())), ("roles", _TEXTS), ("texts", _TEXTS),
    ("copies", pa.list_(pa.int64())), ("to", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), *_DONE,
])


def _batches(rows, schema: pa.Schema, size=lambda row: 1, most: int = 2000):
    """Rows as record batches of bounded size."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _reader(chunk_rows: int, chunk_chars: int, keep: bool):
    """A function for mapInArrow from ordered rows to finished conversations and chunks."""

    def finished(chunk: _Chunk) -> dict:
        t = tables()
        _, first, cost = t.back(chunk.live(), t.end)
        audit, rows, state = _followed(chunk.symbols, chunk.roles, chunk.texts, chunk.copies, t.end, 0)
        rows += [(role, "") for role in finish(state)]
        return chunk.known() | {
            "cost": cost + t.vectors[first][0] + DELETE * chunk.gone(),
            "audit": audit + "I" * len(finish(state)),
            "digest": hashlib.sha256(_joined(rows)).hexdigest(),
            "repaired": [{"role": r, "text": x} for r, x in rows] if keep else None,
        }

    def part_of(chunk: _Chunk, part: int, no: int) -> dict:
        to, cost = tables().table(chunk.live())
        ends = (chunk.roles[0][:1], chunk.roles[-1][:1]) if chunk.roles else (None, None)
        return chunk.known() | {
            "part": part, "no": no, "first": ends[0], "last": ends[1], "gone": chunk.gone(),
            "symbols": chunk.symbols, "roles": chunk.roles, "texts": chunk.texts, "copies": chunk.copies,
            "to": to.tolist(), "costs": cost.tolist(),
        }

    def read(batches):
        # the first conversation may have begun in the part before
        chunk, cut, part, no = None, True, 0, 0
        names = ("conv", "turn", "role", "text", "copies", "blank", "again", "cut_off")
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            parts = batch.column("part")
            for row, (conv, *rest) in enumerate(zip(*columns)):
                if chunk is None:
                    chunk, part = _Chunk(conv), parts[row].as_py()
                elif chunk.conv != conv:
                    yield part_of(chunk, part, no) if cut else finished(chunk)
                    chunk, cut, no = _Chunk(conv), False, no + 1
                elif len(chunk.roles) >= chunk_rows or chunk.chars >= chunk_chars:
                    yield part_of(chunk, part, no)
                    chunk, cut, no = _Chunk(conv), True, no + 1
                chunk.add(*rest)
        if chunk is not None:
            yield part_of(chunk, part, no)

    def weight(row: dict) -> int:
        return 1000 + sum(map(len, row.get("texts") or ())) + len(row.get("audit") or "")

    return lambda batches: _batches(read(batches), _READ_SCHEMA, weight, 2 << 20)


def _scan(start, step, names: list[str], schema: pa.Schema):
    """A function for mapInArrow that carries a value along the rows of each conversation."""

    def rows(batches):
        conv, value = (), None
        for batch in batches:
            for row in batch.select(names).to_pylist():
                if conv != (row["conv"],):
                    conv, value = (row["conv"],), start()
                value, found = step(value, row)
                yield found

    return lambda batches: _batches(rows(batches), schema)


_PLACE = [("conv", pa.string()), ("part", pa.int32()), ("no", pa.int32())]
_PLACE_SQL = "conv string, part int, no int"


def _from_right(vector: int, row: dict):
    """The vector after a chunk, from the chunks to its right."""
    t = tables()
    live = [s for s in row["symbols"] if s >= 0]
    ends = [t.forward(live, vector, q)[1] for q in range(4)]
    found = {k: row[k] for k in ("conv", "part", "no")}
    left = row["to"][vector]
    return left, found | {"vector": vector, "left": left, "cost": row["costs"][vector], "ends": ends}


def _from_left(state: int, row: dict):
    found = {k: row[k] for k in ("conv", "part", "no", "vector", "left", "cost")}
    return row["ends"][state], found | {"state": state}


def _in_order(chunks: DataFrame, ascending: bool = True) -> DataFrame:
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("part", "no")]
    return chunks.repartition("conv").sortWithinPartitions("conv", *order)


_PIECE = [*_KNOWN_TYPES, ("part", pa.int32()), ("no", pa.int32()), ("first", pa.string()), ("last", pa.string()),
          ("gone", pa.int64()), ("left", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()),
          ("state", pa.int32()), ("n", pa.int64()), ("text", pa.binary()), ("repaired", _REPAIRED)]
_PIECE_SQL = (
    f"{_KNOWN}, part int, no int, first string, last string, gone long, left int, cost long, audit string, "
    "state int, n long, text binary, repaired array<struct<role: string, text: string>>"
)


def _pieces(keep: bool):
    """A function for mapInArrow that follows chunks whose vector and state are known."""

    def pieces(batches):
        for batch in batches:
            for row in batch.to_pylist():
                audit, rows, state = _followed(
                    row["symbols"], row["roles"], row["texts"], row["copies"], row["vector"], row["state"]
                )
                own = {k: row[k] for k, _ in _PIECE if k in row}
                more = {"audit": audit, "state": state, "n": len(rows), "text": _joined(rows)}
                kept = [{"role": r, "text": x} for r, x in rows] if keep else None
                yield own | more | {"repaired": kept}

    schema = pa.schema(_PIECE)
    return lambda batches: _batches(pieces(batches), schema, lambda r: 1000 + len(r["text"]), 4 << 20)


def _together(batches):
    """Finished conversations from their pieces in order; texts are hashed as they come."""

    def last(known: dict, audit: list[str], digest, n: int) -> dict:
        for role in finish(known.pop("state")):
            audit.append("I")
            digest.update(b"\n" * (n > 0) + f"{role}:".encode())
            n += 1
        return known | {"audit": "".join(audit), "digest": digest.hexdigest()}

    def rows():
        known = None
        for batch in batches:
            for row in batch.to_pylist():
                if known is None or known["conv"] != row["conv"]:
                    if known is not None:
                        yield last(known, audit, digest, n)
                    known = {k: row[k] for k, _ in _KNOWN_TYPES}
                    known["cost"] = tables().vectors[row["left"]][0]
                    known |= dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
                    known |= {"low": None, "high": None}
                    audit, digest, n, before = [], hashlib.sha256(), 0, None
                known["turns"] += row["turns"] - (row["low"] is not None and row["low"] == known["high"])
                known["low"] = row["low"] if known["low"] is None else known["low"]
                known["high"] = row["high"] if row["high"] is not None else known["high"]
                for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    known[k] += row[k]
                known["cost"] += DELETE * row["gone"]
                if row["first"] is not None:
                    known["illegal"] += before is not None and _illegal(before, row["first"])
                    before = row["last"]
                audit.append(row["audit"])
                known["state"] = row["state"]
                if row["n"]:
                    digest.update(b"\n" * (n > 0) + row["text"])
                    n += row["n"]
        if known is not None:
            yield last(known, audit, digest, n)

    schema = pa.schema([*_KNOWN_TYPES, *_DONE[:3]])
    yield from _batches(rows(), schema, lambda r: 1000 + len(r["audit"]), 2 << 20)


def _faults() -> dict[str, Column]:
    return {
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
        "cut_off": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
    }


def _ordered(turns: DataFrame) -> DataFrame:
    """Different rows with their number of copies and faults, in order over range partitions."""
    order = ("conv", "turn", "role", "digest")
    rows = turns.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.col("copies").cast("long").alias("copies"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumns(_faults() | {"digest": F.md5("text")})
    rows = settled(
        rows.withColumns(
            {"key": F.xxhash64("conv", "role", "text"), "key2": F.xxhash64("digest", "role", "conv")}
        )
    )
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = (
        rows.where("copies > 0 and not blank").groupBy("key", "key2")
        .agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    )
    again = F.coalesce(place > F.col("first"), F.lit(False))
    rows = rows.join(first, ["key", "key2"], "left").withColumn("again", again)
    rows = rows.drop("key", "key2", "first")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def repair(
    turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS, keep: bool = False
) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text and, if present, copies).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with
    keep, also the repaired rows (an array, or several arrays by place for conversations
    of several chunks: see repaired()).

    * Rows are ordered by turn, null turns first, then by role and the MD5 of the text.
      copies says how often a row is there (0: only its conversation is); 1 if absent.
    * Null roles and texts are one space. A null conv_id is a conversation of its own. A
      role counts by its first letter; any other than s, u, a, or none, fits nowhere.
    * blank, duplicate, truncated: rows by their first fault. gaps: turns missing between
      the smallest and the largest. illegal: neighbours other than su, ua, au.
    * audit: the cheapest edits, of these the ASCII-least. repaired_sha256: of role:text
      lines joined by line feeds.
    * Texts are used whole; long conversations are cut into chunks. Other columns are not
      looked at. No rows give no rows.
    """
    done, pieces = _parts(turns, chunk_rows, chunk_chars, keep)
    both = done.drop("repaired").unionByName(
        _in_order(pieces.drop("repaired")).mapInArrow(_together, f"{_KNOWN}, cost long, audit string, digest string")
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    return both.select(
        F.col("conv").cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        gaps.cast("long").alias("gaps"), *counts, "audit", F.col("digest").alias("repaired_sha256"),
    )


def _parts(turns: DataFrame, chunk_rows: int, chunk_chars: int, keep: bool) -> tuple[DataFrame, DataFrame]:
    """Finished conversations, and the followed chunks of the others."""
    if "copies" not in turns.columns:
        turns = turns.withColumn("copies", F.lit(1))
    ordered = _ordered(turns).select(
        F.spark_partition_id().alias("part"), "conv", "turn", "role", "text", "copies", "blank", "again", "cut_off"
    )
    read = settled(ordered.mapInArrow(_reader(chunk_rows, chunk_chars, keep), _READ))
    done = read.where("part is null").select(*[f.split()[0] for f in _KNOWN.split(", ")], "cost", "audit", "digest", "repaired")
    chunks = read.where("part is not null")
    end = tables().end
    names = ["conv", "part", "no", "symbols", "to", "costs"]
    schema = [*_PLACE, ("vector", pa.int32()), ("left", pa.int32()), ("cost", pa.int64()), ("ends", pa.list_(pa.int32()))]
    known = _in_order(chunks.select(*names), ascending=False).mapInArrow(
        _scan(lambda: end, _from_right, names, pa.schema(schema)),
        f"{_PLACE_SQL}, vector int, left int, cost long, ends array<int>",
    )
    names = [n for n, _ in schema]
    states = _in_order(known).mapInArrow(
        _scan(int, _from_left, names, pa.schema([*schema[:-1], ("state", pa.int32())])),
        f"{_PLACE_SQL}, vector int, left int, cost long, state int",
    )
    placed = chunks.drop("cost", "audit", "digest", "repaired", "to", "costs").join(
        states.drop("conv"), ["part", "no"]
    )
    return done, placed.mapInArrow(_pieces(keep), _PIECE_SQL)


def repaired(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """conv_id, place, role, text: the rows of the repaired conversations.

    place rises along a conversation (not by ones where it has several chunks).
    """
    done, pieces = _parts(turns, chunk_rows, chunk_chars, True)
    # a chunk row becomes at most three rows
    width = max(1, (3 * chunk_rows).bit_length())
    base = F.col("part").cast("long") * (1 << 43) + F.col("no").cast("long") * (1 << width)
    more = pieces.select("conv", base.alias("base"), "repaired")
    ends = pieces.groupBy("conv").agg(F.max(F.struct("part", "no", "state")).alias("last")).select(
        "conv", F.lit((1 << 63) - 4).alias("base"), _finishing().alias("repaired")
    )
    all_rows = done.select("conv", F.lit(0).cast("long").alias("base"), "repaired").union(more).union(ends)
    return all_rows.select("conv", "base", F.posexplode("repaired").alias("nth", "row")).select(
        F.col("conv").cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        (F.col("base") + F.col("nth")).alias("place"), "row.role", "row.text",
    )


def _finishing() -> Column:
    """The rows that finish a conversation, by the state of its last chunk."""
    one = [F.struct(F.lit(r).alias("role"), F.lit("").alias("text")) for r in ("user", "assistant")]
    kind = "array<struct<role: string, text: string>>"
    state = F.col("last.state")
    return F.when(state == 1, F.array(*one)).when(state == 2, F.array(one[1])).otherwise(F.array().cast(kind))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after damage that a checksum of id and turn picks.

    Of twenty equal shares one is dropped (copies 0), one emptied, one loses its full
    stops, exclamation and question marks, one is doubled, one is said by the user.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    none = F.lit("")
    return conversations.select(
        "conv_id",
        F.when(fate != 0, F.col("turn").cast("long")).alias("turn"),
        F.when(fate == 0, none).when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate < 2, none).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )
