"""Sums over all pairs of columns, as blocks of matrices.

Each task turns its rows into matrices of BLOCK columns and keeps, per pair of blocks,
what matrix products give for all their pairs of columns at once. The table is read once
and the plan is the same for any number of columns. What the tasks found is merged twice:
in salted groups of blocks first, then per block. Merging reads one block after the other,
so a task holds a block per pair of blocks, however many tasks there were before.

Pairs are counted over the rows where both columns have a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block.
BLOCK = 64
#: Numbers looked at together, which bounds a task's memory whatever the width.
CELLS = 1 << 20
#: Groups in which the tasks' blocks are merged first.
SALTS = 64
#: Differences that leave less than this share of a sum are computed again from the rows.
LOST = 1e-8

_BLOCKS = "first int, second int, salt int, data binary"

State = np.ndarray
Found = Callable[[np.ndarray, np.ndarray, bool], State]
Merge = Callable[[State, State], State]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The columns of a batch; NaN where there is no value."""
    columns = [c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns]
    return np.column_stack(columns) if columns else np.empty((batch.num_rows, 0))


def _packed(states: dict[tuple[int, int], State], salt: int) -> Iterator[pa.RecordBatch]:
    for (i, j), state in states.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i], pa.int32()),
                pa.array([j], pa.int32()),
                pa.array([salt], pa.int32()),
                pa.array([state.tobytes()], pa.binary()),
            ],
            names=["first", "second", "salt", "data"],
        )


def _unpacked(batches, width: int) -> Iterator[tuple[tuple[int, int], State, int]]:
    for batch in batches:
        for i, j, salt, data in zip(*[c.to_pylist() for c in batch.columns]):
            shape = (min(BLOCK, width - i * BLOCK), min(BLOCK, width - j * BLOCK))
            yield (i, j), np.frombuffer(data).reshape(-1, *shape), salt


def _of_rows(found: Found, merge: Merge, width: int):
    """A function for mapInArrow from the table's rows to this task's blocks."""

    def of_rows(batches):
        states: dict[tuple[int, int], State] = {}
        for batch in batches:
            table = _matrix(batch)
            step = max(1, CELLS // max(1, width))
            for at in range(0, len(table), step):
                rows = table[at : at + step]
                blocks = [rows[:, k : k + BLOCK] for k in range(0, width, BLOCK)]
                for i, first in enumerate(blocks):
                    for j in range(i, len(blocks)):
                        new = found(first, blocks[j], i == j)
                        old = states.get((i, j))
                        states[i, j] = new if old is None else merge(old, new)
        # a task that is run again must give the same rows
        yield from _packed(states, TaskContext.get().partitionId() % SALTS)

    return of_rows


def _merged(merge: Merge, width: int):
    def merged(batches):
        states: dict[tuple[int, int, int], State] = {}
        for (i, j), new, salt in _unpacked(batches, width):
            old = states.get((i, j, salt))
            states[i, j, salt] = new if old is None else merge(old, new)
        for (i, j, salt), state in states.items():
            yield from _packed({(i, j): state}, salt)

    return merged


def _pairs(merge: Merge, values: Callable[[State], list[np.ndarray]], width: int, names: list[str]):
    """A function for mapInArrow from blocks to one row per pair of positions, the smaller first."""

    def pairs(batches):
        states: dict[tuple[int, int], State] = {}
        for key, new, _ in _unpacked(batches, width):
            old = states.get(key)
            states[key] = new if old is None else merge(old, new)
        for (i, j), state in states.items():
            a, b = np.meshgrid(
                np.arange(state.shape[1]) + i * BLOCK, np.arange(state.shape[2]) + j * BLOCK, indexing="ij"
            )
            keep = a <= b
            columns = [pa.array(p[keep].astype(np.int32)) for p in (a, b)]
            for value in values(state):
                columns.append(pa.array(value[keep], pa.float64(), mask=np.isinf(value[keep])))
            yield pa.RecordBatch.from_arrays(columns, names=["first", "second", *names])

    return pairs


def _over_pairs(
    columns: DataFrame, found: Found, merge: Merge, values: Callable[[State], list[np.ndarray]], names: list[str]
) -> DataFrame:
    width = len(columns.columns)
    blocks = columns.mapInArrow(_of_rows(found, merge, width), _BLOCKS)
    blocks = blocks.repartition("first", "second", "salt").mapInArrow(_merged(merge, width), _BLOCKS)
    typed = ", ".join(["first int", "second int", *[f"{n} double" for n in names]])
    return blocks.repartition("first", "second").mapInArrow(_pairs(merge, values, width, names), typed)


def _about(column: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Mean, sum of squares about it, and distances from it; exact if all values are equal."""
    moved = column - column[0]
    mean = moved.mean()
    apart = moved - mean
    return column[0] + mean, float(apart @ apart), apart


def _shifted(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values about a middle (0 if there is none), whether there is one, infinite ones, the middles."""
    endless = np.isinf(block)
    here = ~np.isnan(block)
    plain = np.where(here & ~endless, block, 0.0)
    usable = here & ~endless
    least = np.where(usable, block, np.inf).min(axis=0, initial=np.inf)
    most = np.where(usable, block, -np.inf).max(axis=0, initial=-np.inf)
    middle = plain.sum(axis=0) / np.maximum(usable.sum(axis=0), 1)
    # equal values are their own middle, so that nothing is left of them
    middle = np.where(least == most, least, middle)
    return np.where(usable, plain - middle, 0.0), here.astype(np.float64), endless.astype(np.float64), middle


def _moments(first: np.ndarray, second: np.ndarray, same: bool) -> State:
    """Rows, means, sums of squares about the means, and of products, for all pairs."""
    x, in_x, inf_x, middle_x = _shifted(first)
    y, in_y, inf_y, middle_y = (x, in_x, inf_x, middle_x) if same else _shifted(second)
    rows = in_x.T @ in_y
    each = np.maximum(rows, 1)
    sum_x, sum_y = x.T @ in_y, in_x.T @ y
    square_x, square_y = (x * x).T @ in_y, in_x.T @ (y * y)
    state = np.stack(
        [
            rows,
            middle_x[:, None] + sum_x / each,
            middle_y[None, :] + sum_y / each,
            square_x - sum_x * sum_x / each,
            square_y - sum_y * sum_y / each,
            x.T @ y - sum_x * sum_y / each,
        ]
    )
    lost = (rows > 0) & ((state[3] <= LOST * square_x) & (square_x > 0) | (state[4] <= LOST * square_y) & (square_y > 0))
    for a, b in zip(*np.nonzero(lost)):
        both = (in_x[:, a] > 0) & (in_y[:, b] > 0) & (inf_x[:, a] == 0) & (inf_y[:, b] == 0)
        if both.any():
            mean_x, about_x, apart_x = _about(first[both, a])
            mean_y, about_y, apart_y = _about(second[both, b])
            state[1:, a, b] = mean_x, mean_y, about_x, about_y, apart_x @ apart_y
    endless = (inf_x.T @ in_y + in_x.T @ inf_y) > 0
    state[1:, endless] = np.nan
    return state


def _joined(old: State, new: State) -> State:
    """The moments of two sets of rows as those of one."""
    rows = old[0] + new[0]
    share = new[0] / np.maximum(rows, 1)
    far_x, far_y = new[1] - old[1], new[2] - old[2]
    weight = old[0] * share
    joined = np.stack(
        [
            rows,
            old[1] + far_x * share,
            old[2] + far_y * share,
            old[3] + new[3] + far_x * far_x * weight,
            old[4] + new[4] + far_y * far_y * weight,
            old[5] + new[5] + far_x * far_y * weight,
        ]
    )
    # a set without rows says nothing, not even where its middle is
    return np.where(old[0] == 0, new, np.where(new[0] == 0, old, joined))


def _pearson(state: State) -> list[np.ndarray]:
    """The correlations; infinite stands for none, where a column does not vary."""
    spread = np.sqrt(np.maximum(state[3], 0)) * np.sqrt(np.maximum(state[4], 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.clip(state[5] / spread, -1.0, 1.0)
    return [np.where((spread == 0) | (state[0] < 2), np.inf, found)]


def correlations(values: DataFrame) -> DataFrame:
    """first, second (positions of columns, first <= second), pearson of columns of doubles.

    NULL stands for a missing value, and in pearson for a column that does not vary over
    the rows of its pair. Infinite values give NaN. An empty table gives no rows, or NULLs.
    """
    return _over_pairs(values, _moments, _joined, _pearson, ["pearson"])


def _counts(first: np.ndarray, second: np.ndarray, same: bool) -> State:
    both = first.T @ second
    alone_first = np.broadcast_to(first.sum(axis=0)[:, None], both.shape)
    alone_second = np.broadcast_to(second.sum(axis=0)[None, :], both.shape)
    return np.stack([both, alone_first, alone_second])


def joint_counts(df: DataFrame, flags: list[Column]) -> DataFrame:
    """first, second (positions of flags, first <= second), rows with both, with either one.

    Flags must not be NULL. An empty table gives no rows, or zeros.
    """
    names = ["both", "with_first", "with_second"]
    table = df.select(*[flag.cast("double").alias(f"f{k}") for k, flag in enumerate(flags)])
    found = _over_pairs(table, _counts, np.add, list, names)
    return found.withColumns({n: F.col(n).cast("long") for n in names})
