"""Descriptor distances: as column expressions, and as the block kernel used for nearest pairs."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_distance(a, b) -> Column:
    """Euclidean distance of two numeric array columns."""
    squares = F.zip_with(a, b, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def hamming_distance(a, b) -> Column:
    """Number of differing bits of two array<long> columns."""
    differing = F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differing, F.lit(0), lambda s, v: s + v).cast("double")


def _unpack(words: np.ndarray) -> np.ndarray:
    octets = np.ascontiguousarray(words, dtype="<i8").view(np.uint8)
    return np.unpackbits(octets, axis=1).astype(np.float32) * 2 - 1


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    signs_a, signs_b = _unpack(a), _unpack(b)
    return (signs_a.shape[1] - signs_a @ signs_b.T) / 2  # whole numbers, exact in float32


def _nearest_keys(sides, bits: int, step: int):
    """Two nearest of either side at once, from one product of signs.

    A cell of the product is ``step`` times the distance plus the column's place in order of ids, a
    whole number that float32 holds exactly; its smallest values name the nearest, ties to lower ids.
    For the way back the row's place takes the place of the column's.
    """
    (q_ids, q), (t_ids, t) = sides
    orders = [np.argsort(ids, kind="stable") for ids in (q_ids, t_ids)]
    places = [np.empty(len(o), np.float32) for o in orders]
    for place, order in zip(places, orders, strict=True):
        place[order] = np.arange(len(order), dtype=np.float32)
    ones = np.ones((len(q), 1), np.float32)
    shift = (step * bits // 2 + places[1])[:, None].astype(np.float32)
    table = np.hstack([q, ones]) @ np.hstack([t * np.float32(-step / 2), shift]).T
    for axis, (ids, (others, _), order) in enumerate(zip((q_ids, t_ids), (sides[1], sides[0]), orders[::-1])):
        if axis:
            table += places[0][:, None] - places[1]
        across = 1 - axis
        least = [table.min(across)]
        if table.shape[across] > 1:
            at = order[(least[0] % step).astype(np.int64)]
            cells = (np.arange(len(ids)), at) if not axis else (at, np.arange(len(ids)))
            table[cells] = np.inf
            least.append(table.min(across))
            table[cells] = least[0]
        keys = np.stack(least, 1).astype(np.int64)
        near = others[order[keys % step]]
        yield axis, np.repeat(ids, keys.shape[1]), near.ravel(), (keys // step).ravel().astype(np.float64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def two_nearest(table: np.ndarray, ids: np.ndarray, refine, slack: float):
    """Row numbers, column numbers and distances of the two nearest columns per row.

    ``table`` may be off by ``slack``: everything within it of the second value is
    measured again by ``refine``, so the order is exact. Ties go to the lower id.
    """
    every = np.arange(len(table))
    first = table.argmin(1)
    second = table[every, first]
    if table.shape[1] > 1:
        table[every, first] = np.inf
        least, second = second, table.min(1)
        table[every, first] = least
    rows, cols = np.nonzero(table <= (second + slack)[:, None])
    exact = refine(rows, cols)
    order = np.lexsort((ids[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < 2
    return rows[keep], cols[keep], exact[keep]


def nearest_both_ways(q_ids, q, t_ids, t, binary: bool):
    """Two nearest in either direction from one distance table.

    Yields (direction, source ids, target ids, distances); direction 0 goes from
    the query block to the target block, 1 back.
    """
    if binary:
        bits, step = q.shape[1] * 64, 1 << max(len(q_ids), len(t_ids), 2).bit_length()
        if step * (bits + 1) < 1 << 24:
            yield from _nearest_keys([(q_ids, _unpack(q)), (t_ids, _unpack(t))], bits, step)
            return
        table, slack = _hamming(q, t), 0.0

        def measure(rows, cols):
            return table[rows, cols].astype(np.float64)
    else:
        q, t = q.astype(np.float64), t.astype(np.float64)
        table = _squares(q, t)
        slack = 1e-9 * (1.0 + (q * q).sum(1).max() + (t * t).sum(1).max())

        def measure(rows, cols, step=65536):
            parts = [
                ((q[rows[k : k + step]] - t[cols[k : k + step]]) ** 2).sum(1)
                for k in range(0, len(rows), step)
            ]
            return np.sqrt(np.concatenate(parts)) if parts else np.zeros(0)

    rows, cols, exact = two_nearest(table, t_ids, measure, slack)
    yield 0, q_ids[rows], t_ids[cols], exact
    rows, cols, exact = two_nearest(np.ascontiguousarray(table.T), q_ids, lambda r, c: measure(c, r), slack)
    yield 1, t_ids[rows], q_ids[cols], exact
