"""Approximate nearest neighbours by few stable projections, kd-trees and a chi-square test.

Unit vectors are projected on DIMS Gaussian directions. At original distance d a projected squared
distance is d * d times a chi-square variable of DIMS degrees, so neighbours come early when
candidates are taken in order of projected distance. Each is verified with the exact cosine, and
the search ends when a neighbour closer than the worst kept one would, with probability
CONFIDENCE, have come already.

The top of the kd-tree is fitted on at most SAMPLE vectors and cuts all rows into cells; a cell builds
its own tree. A query starts in the cell it lies in; then it visits the cells that the same test, with
the distance reached, can't rule out. Equal vectors are one entry with their k + 1 smallest ids, which
is all that any query can return of them, so copies cost nothing. Queries stream through a cell.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id. Ties go to the smaller id; a query with fewer candidates returns
them all; repeated rows of one id are one candidate. An empty table gives an empty result. Further
columns are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle, top_n
from aeromosaic.llm.texts import table

DIMS = 8
CONFIDENCE = 0.96
SAMPLE = 20_000  # vectors that the cells are fitted on; all are indexed
CELL_ROWS = 8192
LEAF = 32
_STEP = 8  # leaves opened first
_CHUNK = 256  # candidates verified at once
_TINY = 1e-12
SEED = 7


def chi_square(x: np.ndarray) -> np.ndarray:
    """Distribution function of a chi-square variable of DIMS (even) degrees."""
    h = np.asarray(x, np.float64) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    with np.errstate(invalid="ignore", over="ignore"):
        for i in range(1, DIMS // 2):
            term = term * h / i
            total = total + term
        out = 1 - np.exp(-h) * total
    return np.where(np.isinf(h), 1.0, out)


def _quantile() -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < CONFIDENCE else (low, mid)
    return high


#: The test holds at a projected squared distance of so many times the squared distance reached.
_QUANTILE = _quantile()


def directions(length: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((length, DIMS))


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length one; a common scale first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


class Cells:
    """The top of the kd-tree: split planes, and the box of each cell."""

    def __init__(self, points: np.ndarray, depth: int):
        self.low, self.high = [], []
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, left, right (~cell)
        box = np.full(DIMS, -np.inf), np.full(DIMS, np.inf)
        self.root = self._cut(points, depth, *box)
        self.low, self.high = np.stack(self.low), np.stack(self.high)

    def _cut(self, points, depth, low, high):
        spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(DIMS)
        if depth == 0 or spread.max() == 0:
            self.low.append(low)
            self.high.append(high)
            return ~(len(self.low) - 1)
        axis = int(spread.argmax())
        value = float(np.median(points[:, axis]))
        right = points[:, axis] > value
        place = len(self.splits)
        self.splits.append((axis, value, 0, 0))
        upper, lower = high.copy(), low.copy()
        upper[axis], lower[axis] = value, value
        a = self._cut(points[~right], depth - 1, low, upper)
        b = self._cut(points[right], depth - 1, lower, high)
        self.splits[place] = (axis, value, a, b)
        return place

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root, np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            for at in np.unique(node[inner]):
                axis, value, a, b = self.splits[at]
                here = np.flatnonzero(node == at)
                node[here] = np.where(points[here, axis] > value, b, a)
        return ~node

    def bounds(self, point: np.ndarray) -> np.ndarray:
        """Projected squared distance from a point to each cell at least."""
        return _box_bounds(point, self.low, self.high)


def _box_bounds(point, low, high):
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(1)


class Tree:
    """A kd-tree over the projections of one cell, its leaves with tight boxes."""

    def __init__(self, vectors: np.ndarray, points: np.ndarray, ids: list):
        self.vectors, self.points, self.ids = vectors, points, ids
        self.scaled = units(vectors)
        self.leaves = []
        self._cut(np.arange(len(points)))
        self.low = np.stack([points[x].min(0) for x in self.leaves])
        self.high = np.stack([points[x].max(0) for x in self.leaves])

    def _cut(self, rows):
        if len(rows) <= LEAF:
            self.leaves.append(rows)
            return
        axis = int(np.ptp(self.points[rows], axis=0).argmax())
        order = rows[self.points[rows, axis].argsort(kind="stable")]
        half = len(rows) // 2
        self._cut(order[:half])
        self._cut(order[half:])

    def search(self, query: np.ndarray, point: np.ndarray, want: int, worst: float):
        """(score, id) of the best ids in this cell, best first, given a distance reached before."""
        bounds = _box_bounds(point, self.low, self.high)
        order = bounds.argsort(kind="stable")
        best: list[tuple[float, int]] = []
        at, step = 0, _STEP
        while at < len(order) and np.isinf(worst):  # the nearest leaves, until any distance is reached
            rows = np.concatenate([self.leaves[k] for k in order[at : at + step]])
            best, worst = self._verify(query, rows, best, want, worst)
            at, step = at + step, 2 * step
        stop = at + int(np.searchsorted(bounds[order[at:]], worst * _QUANTILE + _TINY, "right"))
        if at >= stop:
            return best
        rows = np.concatenate([self.leaves[k] for k in order[at:stop]])
        gap = self.points[rows] - point
        near = (gap * gap).sum(1)
        due = near <= worst * _QUANTILE + _TINY
        rows, near = rows[due], near[due]
        order = near.argsort(kind="stable")
        for at in range(0, len(order), _CHUNK):
            some = order[at : at + _CHUNK]
            if near[some[0]] > worst * _QUANTILE + _TINY:  # the test holds from here on
                break
            best, worst = self._verify(query, rows[some], best, want, worst)
        return best

    def _verify(self, query, rows, best, want, worst):
        """The best ids with some more rows, by exact cosines."""
        least = best[-1][0] if len(best) >= want else -np.inf
        rows = rows[self.scaled[rows] @ query >= least - 1e-9]
        scores = (self.scaled[rows] * query).sum(1)  # the same sum for a vector wherever it stands
        if len(rows) > want:
            keep = np.argpartition(-scores, want - 1)[:want]
            keep = np.flatnonzero(scores >= scores[keep].min())  # all ties of the last one
            rows, scores = rows[keep], scores[keep]
        if len(rows):
            best = best + [(s, i) for r, s in zip(rows, scores.tolist(), strict=True) for i in self.ids[r]]
            best = sorted(set(best), key=lambda x: (-x[0], x[1]))[:want]
        if len(best) >= want:
            worst = min(worst, max(0.0, 2 - 2 * best[-1][0]))
        return best, worst


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, as doubles."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where(
        F.col("vec_id").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n")
    first = sizes.first()
    return rows.where(F.size("v") == F.lit(first["n"] if first else 0))


def _entries(rows: DataFrame, want: int, is_query) -> DataFrame:
    """(v, ids, asked): one row for each vector, with its smallest ids and whether any is a query."""
    asked = rows.groupBy("v").agg(F.max(is_query).alias("asked"))
    ids = top_n(rows.distinct(), ["v"], ["vec_id"], want, "__rank").groupBy("v").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")
    )
    return ids.join(asked, "v")


def _placed(cells):
    def run(batches):
        for batch in batches:
            v = _matrix(batch.column("v"))
            if len(v):
                of = cells.value.of(units(v) @ directions(v.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of), *[batch.column(c) for c in ("v", "ids", "asked")]],
                    ["cell", "v", "ids", "asked"],
                )

    return run


_FOUND = "v array<double>, best array<struct<score:double,id:long>>, visit array<long>"


def _visits(cells, want, first: bool):
    """Search streamed queries in the tree of their cell; rows come cell by cell, entries first."""

    def run(batches):
        cell, entries, tree = None, [], None
        for batch in batches:
            of, query = batch.column("cell").to_numpy(), np.asarray(batch.column("query"))
            cuts = np.r_[0, np.flatnonzero((of[1:] != of[:-1]) | (query[1:] != query[:-1])) + 1, len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if of[a] != cell:
                    cell, entries, tree = of[a], [], None
                if not query[a]:
                    entries.append(part)
                    continue
                if tree is None and entries:
                    v = np.concatenate([_matrix(p.column("v")) for p in entries])
                    ids = [i for p in entries for i in p.column("ids").to_pylist()]
                    tree = Tree(v, units(v) @ directions(v.shape[1]), ids)
                yield answers(part, tree, int(cell))

    def answers(part, tree, cell):
        v = _matrix(part.column("v"))
        scaled = units(v)
        points = scaled @ directions(v.shape[1])
        found, visit = [], []
        for row, worst in enumerate(part.column("worst").to_pylist()):
            best = tree.search(scaled[row], points[row], want, np.inf if worst is None else worst) if tree else []
            found.append([{"score": s, "id": i} for s, i in best])
            cells_left = np.zeros(0, np.int64)
            if first:
                reached = max(0.0, 2 - 2 * best[-1][0]) if len(best) >= want else np.inf
                near = cells.value.bounds(points[row]) <= reached * _QUANTILE + _TINY
                cells_left = np.flatnonzero(near)
                cells_left = cells_left[cells_left != cell]
            visit.append(cells_left.tolist())
        kind = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [part.column("v"), pa.array(found, kind), pa.array(visit, pa.list_(pa.int64()))],
            ["v", "best", "visit"],
        )

    return run


def _round(entries: DataFrame, queries: DataFrame, cells, want: int, first: bool) -> DataFrame:
    both = entries.select(
        "cell", F.lit(False).alias("query"), "v", "ids", F.lit(None).cast("double").alias("worst")
    ).union(queries.select("cell", F.lit(True), "v", F.lit(None).cast("array<long>"), "worst"))
    dealt = both.repartition("cell").sortWithinPartitions("cell", "query")
    return dealt.mapInArrow(_visits(cells, want, first), _FOUND)


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for every query row.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.
    """
    spark, want = vectors.sparkSession, k + 1
    rows = settle(_usable(vectors))
    entries = settle(_entries(rows, want, is_query))
    n = entries.count()
    share = min(1.0, SAMPLE / max(n, 1))
    near = (F.xxhash64("v") / F.lit(2.0**64)) + 0.5 < share
    sample = _matrix(entries.where(near).select("v").limit(2 * SAMPLE).toArrow()["v"])
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / CELL_ROWS)))) if len(sample) else 0
    points = units(sample) @ directions(sample.shape[1]) if len(sample) else np.zeros((0, DIMS))
    cells = spark.sparkContext.broadcast(Cells(points, depth))

    schema = "cell long, v array<double>, ids array<long>, asked boolean"
    placed = settle(entries.mapInArrow(_placed(cells), schema))
    home = placed.where("asked").select("cell", "v", F.lit(None).cast("double").alias("worst"))
    start = settle(_round(placed, home, cells, want, True))
    reached = F.when(
        F.size("best") >= want, F.greatest(F.lit(0.0), 2 - 2 * F.try_element_at("best", F.lit(-1))["score"])
    )
    more = start.select(F.explode("visit").alias("cell"), "v", reached.alias("worst"))
    found = start.union(_round(placed, more, cells, want, False))

    one = found.select("v", F.explode("best").alias("b")).select("v", "b.score", "b.id")
    best = top_n(one, ["v"], [F.desc("score"), F.asc("id")], want, "__rank")
    lists = best.groupBy("v").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("best")
    )
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (
        asked.join(lists, "v")
        .select("query_id", F.posexplode(others).alias("rank", "b"))
        .select(
            "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"),
            (-F.col("b.less")).alias("score"),
        )
    )


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op1_neighbours": op1_neighbours}
ORACLES: dict[str, str] = {}
