"""Draws of a block of pool rows into many mixtures at once, as arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from methmix.functions.hashing import PRIME

PAIRS = 1 << 15  # (row, mixture) pairs of a block, whose arrays stay in a core's cache
MIXTURES = 512  # mixtures of a block, at most
HALF_BITS = 14  # of the 28 bits of a word of a row
HELD = 1 << 22  # sums a task holds before it hands them on


@dataclass
class Draws:
    """The mixtures that draw from one cell type: the `weights` that make draws of the parts of rows, and `limits`, as shares of PRIME.
    `limits` and `copies` have a row for each copy that a row may be drawn as; mixtures with more copies come first, `widths` says how
    many have the n-th."""

    numbers: np.ndarray
    weights: np.ndarray
    limits: np.ndarray
    copies: np.ndarray
    widths: np.ndarray


def draws_by_type(table: pa.Table) -> dict[str, Draws]:
    """The table of dense draws (see `operators.mixing`) by cell type."""
    frame = table.to_pandas().sort_values(["cell_type", "mixture_no", "mix_a", "mix_b", "mix_c", "copy_no"])
    found = {}
    for cell_type, own in frame.groupby("cell_type"):
        units = own.groupby(["mixture_no", "mix_a", "mix_b", "mix_c"], sort=False)
        unit, layer = units.ngroup().to_numpy(), units.cumcount().to_numpy()
        sizes = np.bincount(unit)
        place = np.empty(len(sizes), int)
        place[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
        at = place[unit]
        limits, copies = (np.zeros((sizes.max(), len(sizes)), t) for t in (float, np.int64))
        # A whole draw is below the limit just where it is below the next whole number.
        limits[layer, at], copies[layer, at] = np.ceil(own["limit"].to_numpy()) / PRIME, own["copy_no"].to_numpy()
        numbers, words = np.empty(len(sizes), np.int64), np.empty((3, len(sizes)), np.int64)
        numbers[at] = own["mixture_no"].to_numpy()
        words[:, at] = own[["mix_a", "mix_b", "mix_c"]].to_numpy().T
        found[cell_type] = Draws(numbers, word_weights(*words), limits, copies, (sizes[:, None] > np.arange(sizes.max())).sum(axis=0))
    return found


def row_parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The halves of the words of each row, and a one."""
    mask = (1 << HALF_BITS) - 1
    return np.stack([x >> HALF_BITS, x & mask, y >> HALF_BITS, y & mask, np.ones_like(x)], axis=1).astype(float)


def word_weights(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What each of `row_parts` adds to (a x + b y + c + 1/2) / PRIME, up to whole numbers."""
    return np.stack([(a << HALF_BITS) % PRIME, a, (b << HALF_BITS) % PRIME, b, c + 0.5]) / PRIME


class Room:
    """Arrays for one block, used again by the next."""

    def __init__(self, pairs: int) -> None:
        self.shares, self.whole = np.empty((2, pairs))

    def draws(self, parts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """`hashing.draw` and a half of all rows and mixtures, as shares of PRIME: the fraction of one product. It errs by less than
        2^-34, as its terms add up to less than 2^16; a draw and a half lies 2^-32 from the next limit, which is a whole number."""
        shape = len(parts), weights.shape[1]
        shares, whole = (part[:shape[0] * shape[1]].reshape(shape) for part in (self.shares, self.whole))
        np.matmul(parts, weights, out=shares)
        np.floor(shares, out=whole)
        return np.subtract(shares, whole, out=shares)


def _times(draw: np.ndarray, draws: Draws, at: slice) -> np.ndarray:
    """How often each row is drawn into each mixture of `at`."""
    times = draw < draws.limits[0, at]
    if len(draws.limits) > 1:
        times = times.astype(np.uint8 if len(draws.limits) < 256 else np.uint32)
    for limits, width in zip(draws.limits[1:], draws.widths[1:]):
        own = min(width, at.stop) - at.start
        if own <= 0:
            break
        times[:, :own] += draw[:, :own] < limits[at.start:at.start + own]
    return times


class _Sums:
    """Sums of one group of rows: per mixture the rows drawn, the most copies of one, and of each value the sum and the drawn nulls."""

    def __init__(self, draws: Draws, values: int) -> None:
        self.draws = draws
        self.sums = np.zeros((len(draws.numbers), values + 1), np.int64)
        self.most = np.zeros(len(draws.numbers), np.int64)
        self.nulls = None

    def add(self, at: slice, draw: np.ndarray, times: np.ndarray, values: np.ndarray, nulls: np.ndarray | None) -> None:
        layers = len(self.draws.limits)
        bound = float(np.abs(values.astype(float)).sum(axis=0).max()) * layers
        if bound >= 2.0 ** 62:
            raise OverflowError("values too large to be summed as 64-bit integers")
        # Floating sums are exact as long as they stay below the digits of their type.
        exact = np.float32 if bound < 2 ** 24 else float if bound < 2 ** 53 else np.int64
        self.sums[at] += (times.T.astype(exact, copy=False) @ values.astype(exact)).astype(np.int64)
        if layers == 1:
            np.maximum(self.most[at], self.draws.copies[0, at] * (self.sums[at, 0] > 0), out=self.most[at])
        else:
            drawn = np.where(draw.min(axis=0) < self.draws.limits[:, at], self.draws.copies[:, at], 0)
            np.maximum(self.most[at], drawn.max(axis=0), out=self.most[at])
        if nulls is not None:
            if self.nulls is None:
                self.nulls = np.zeros((len(self.most), nulls.shape[1]), np.int64)
            self.nulls[at] += (times.T.astype(float) @ nulls).astype(np.int64)


def _emitted(held: dict[tuple, _Sums], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (_, group), own in held.items():
        drawn = own.sums[:, 0] > 0
        sums, columns = own.sums[drawn], [pa.array(own.draws.numbers[drawn])]
        columns += [pa.array([group] * len(sums), schema.field(1).type), pa.array(sums[:, 0]), pa.array(own.most[drawn])]
        for i in range(1, sums.shape[1]):
            missing = None if own.nulls is None else own.nulls[drawn, i - 1] == sums[:, 0]
            columns.append(pa.array(sums[:, i], mask=missing))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
    held.clear()


def summed_draws(batches: Iterator[pa.RecordBatch], by_type: dict[str, Draws], schema: pa.Schema,
                 pairs: int = PAIRS, mixtures: int = MIXTURES, most_held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Sums of the drawn rows by mixture and group, from batches of (cell type, row_x, row_y, group, values). A group may come out in several rows.

    A task holds at most about `most_held` sums. Rows are sorted by group, so that a block of draws becomes the sums of a group by one product.
    """
    held, size, room = {}, 0, None
    for batch in batches:
        types = pc.dictionary_encode(batch.column(0))
        groups = pc.dictionary_encode(batch.column(3), null_encoding="encode")
        type_of, group_of = (e.indices.fill_null(-1).to_numpy(zero_copy_only=False) for e in (types, groups))
        parts = row_parts(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)))
        columns = batch.columns[4:]
        values = np.stack([np.ones(len(parts), np.int64), *[c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns]], axis=1)
        nulls = None
        if any(c.null_count for c in columns):
            nulls = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(float)
        order = np.lexsort((group_of, type_of))
        ends = np.flatnonzero((np.diff(type_of[order]) != 0) | (np.diff(group_of[order]) != 0)) + 1
        for rows in np.split(order, ends) if len(order) else []:
            cell_type = types.dictionary[type_of[rows[0]]].as_py() if type_of[rows[0]] >= 0 else None
            draws = by_type.get(cell_type)
            if draws is None:
                continue
            key = (cell_type, groups.dictionary[group_of[rows[0]]].as_py())
            if key not in held:
                held[key] = _Sums(draws, len(columns))
                size += held[key].sums.size
            room = room or Room(pairs)
            for lo in range(0, len(draws.numbers), mixtures):
                at = slice(lo, min(lo + mixtures, len(draws.numbers)))
                step = pairs // (at.stop - lo)
                for block in (rows[i:i + step] for i in range(0, len(rows), step)):
                    draw = room.draws(parts[block], draws.weights[:, at])
                    held[key].add(at, draw, _times(draw, draws, at), values[block], None if nulls is None else nulls[block])
            if size > most_held:
                yield from _emitted(held, schema)
                size = 0
    yield from _emitted(held, schema)
