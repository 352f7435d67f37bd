"""Benchmark decontamination with suffix arrays over the training texts.

Every shard of the corpus (one Arrow batch of whole documents) gets a suffix array of words;
every suffix of every test item is binary-searched in it, one more word at a time, which gives
its longest verbatim match and all places of each window. Words that no test item has end every
match, so they cut the shard into runs, and runs shorter than the shortest window leave the
array: it shrinks to what can match, whatever the corpus.

A window is ``window`` consecutive words of an item; an item with fewer words is one window.
Test items are taken in blocks of bounded bytes, each against all documents. Null and empty
texts have no words: as documents they are clean, as items they have no window. Repeated rows
are judged one by one; an item id that stands in several rows counts once, a null one marks
words but isn't listed. Empty tables and further columns of any name are fine.
"""

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle
from aeromosaic.llm.texts import letter_words, map_texts, named, table, unwrapped, wrapped

WINDOW = 13
SHARE = 20  # a document is contaminated if at least one word in SHARE is hit
BLOCK_BYTES = 16 << 20  # text of the test items that are searched in one pass


class Tests:
    """Test items of a block as one array of word numbers, 0 after each item."""

    def __init__(self, rows, window: int):
        self.vocabulary: dict[bytes, int] = {}
        ids, items, self.names = [], [], []
        for name, text in rows:
            words = letter_words(text)
            if not words:
                continue
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [0]
            items += [len(self.names)] * (len(words) + 1)
            self.names.append(None if name is None else str(name))
        self.ids = np.array([*ids, 0], np.int64)
        self.items = np.array([*items, -1], np.int64)
        ends = np.flatnonzero(self.ids[:-1] == 0)
        starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        self.starts = np.flatnonzero(self.ids > 0)  # every suffix
        self.left = np.repeat(ends, ends - starts) - self.starts  # words to the item's end
        first = np.repeat(starts, ends - starts) == self.starts
        size = np.repeat(ends - starts, ends - starts)
        # words of the window that starts here, 0 for none
        self.window = np.where(self.left >= window, window, np.where(first, size, 0))
        self.shortest = int(self.window[self.window > 0].min(initial=window))
        self.longest = int(self.left.max(initial=0))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of a 0-separated array, ordered by their first ``depth`` words."""
    rank = ids.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        after[rank == 0] = 0
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh = np.r_[0, (sorted_[1:] != sorted_[:-1]).cumsum()]
        # a separator keeps rank 0, and nothing behind it counts
        rank = np.empty_like(rank)
        rank[order] = fresh + (0 if len(ids) and ids[order[0]] == 0 else 1)
        if len(ids):
            rank[ids == 0] = 0
        if fresh[-1] == len(ids) - 1:
            break
        step *= 2
    return order[ids[order] > 0]


def _bound(words, array, lo, hi, depth, wanted, right: bool):
    """First place in [lo, hi) whose word at ``depth`` is not before (or is after) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        at = words[np.minimum(array[np.minimum(mid, len(array) - 1)] + depth, len(words) - 1)]
        below = (at <= wanted) if right else (at < wanted)
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)


def search(words: np.ndarray, array: np.ndarray, tests: Tests):
    """Longest match of every test suffix, and the range of the array that has its window."""
    n = len(tests.starts)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(array), np.int64)
    longest = np.zeros(n, np.int64)
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    active = np.arange(n) if len(array) else np.arange(0)
    depth = 0
    while len(active):
        wanted = tests.ids[tests.starts[active] + depth]
        a, b = lo[active], hi[active]
        a, b = _bound(words, array, a, b, depth, wanted, False), _bound(words, array, a, b, depth, wanted, True)
        found = a < b
        active, a, b = active[found], a[found], b[found]
        depth += 1
        lo[active], hi[active], longest[active] = a, b, depth
        whole = tests.window[active] == depth
        first[active[whole]], last[active[whole]] = a[whole], b[whole]
        active = active[tests.left[active] > depth]
    return longest, first, last


def _kept_runs(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Places whose runs of test words are long enough to hold a window."""
    inside = np.r_[0, (ids > 0).astype(np.int8), 0]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    long_ = ends - starts >= shortest
    mark = np.zeros(len(ids) + 1, np.int32)
    mark[starts[long_]] += 1
    mark[ends[long_]] -= 1
    return np.flatnonzero(mark.cumsum()[:-1])


def _spread(first, last):
    """All places of ranges, and the range each belongs to."""
    size = last - first
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(size.cumsum() - size, size) + first[owner], owner


def judge(texts, tests: Tests):
    """(words, spans, items, longest) of each text: a shard's array, searched by every suffix."""
    n_words, ids, places, rows = [], [], [], []
    get = tests.vocabulary.get
    for row, text in enumerate(texts):
        words = letter_words(text)
        n_words.append(len(words))
        found = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        kept = _kept_runs(found, tests.shortest)
        if len(kept):
            gap = np.flatnonzero(np.diff(kept) > 1) + 1  # separators between runs
            ids += [np.insert(found[kept], gap, 0), [0]]
            places += [np.insert(kept, gap, -1), [-1]]
            rows += [np.full(len(kept) + len(gap) + 1, row)]
    spans, items = [[] for _ in n_words], [[] for _ in n_words]
    longest = [0] * len(n_words)
    if not ids:
        return n_words, spans, items, longest
    ids, places, rows = (np.concatenate(x).astype(np.int64) for x in (ids, places, rows))
    array = suffix_array(ids, tests.longest)
    match, first, last = search(ids, array, tests)

    # words that any window covers: each range of places is marked once, whoever shares it
    used = np.flatnonzero(last > first)
    ranges = np.unique(np.stack([first[used], last[used], tests.window[used]], 1), axis=0)
    at, owner = _spread(ranges[:, 0], ranges[:, 1])
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, array[at], 1)
    np.add.at(mark, array[at] + ranges[owner, 2], -1)
    covered = np.r_[False, mark.cumsum()[:-1] > 0, False].astype(np.int8)
    edges = np.flatnonzero(np.diff(covered))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        spans[rows[a]].append((int(places[a]), int(places[b - 1]) + 1))

    for suffix in used:  # documents of an item's windows
        name = tests.names[tests.items[tests.starts[suffix]]]
        if name is not None:
            for row in np.unique(rows[array[first[suffix] : last[suffix]]]):
                items[row].append(name)
    # the longest match that starts at or passes each place
    best = np.flatnonzero(match >= tests.shortest)
    if len(best):
        lo, hi = _range_of(ids, array, tests, best, match)
        at, owner = _spread(lo, hi)
        reach = np.zeros(len(n_words), np.int64)
        np.maximum.at(reach, rows[array[at]], match[best][owner])
        longest = reach.tolist()
    return n_words, spans, [sorted(set(x)) for x in items], longest


def _range_of(ids, array, tests, suffixes, match):
    """The range of the array that shares each suffix's longest match."""
    lo, hi = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), len(array), np.int64)
    for depth in range(int(match[suffixes].max())):
        on = np.flatnonzero(match[suffixes] > depth)
        wanted = tests.ids[tests.starts[suffixes[on]] + depth]
        a, b = lo[on], hi[on]
        lo[on] = _bound(ids, array, a, b, depth, wanted, False)
        hi[on] = _bound(ids, array, a, b, depth, wanted, True)
    return lo, hi


_SPANS = "array<struct<start:long,end:long>>"


def _columns(k: int) -> str:
    return f"__words_{k} long, __spans_{k} {_SPANS}, __items_{k} array<string>, __longest_{k} long"


def _searcher(shared):
    def start():
        tests = shared.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def work(column):
            words, spans, items, longest = judge(column.to_pylist(), tests)
            rows = [[{"start": a, "end": b} for a, b in x] for x in spans]
            return [
                pa.array(words, pa.int64()), pa.array(rows, span),
                pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64()),
            ]

        return work

    return start


def _merged(spans):
    """Spans of several passes as one union, by one fold over them in order."""
    last = lambda acc: F.element_at(acc, -1)
    grow = lambda acc, x: F.concat(
        F.slice(acc, 1, F.size(acc) - 1),
        F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))),
    )
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), grow(acc, x)
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def test_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES):
    """Test items in blocks of about ``block_bytes`` of text, one block at a time on the driver."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield b, n, Tests(benchmark.where(block == b).select("item_id", "text").collect(), window)


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns, n_words, hit spans (words, end exclusive), items found, longest match."""
    spark, found, out = docs.sparkSession, docs, []
    columns = keep if "text" in keep else [*keep, "text"]
    for b, n, tests in test_blocks(benchmark, window, block_bytes):
        shared = spark.sparkContext.broadcast(tests)
        found = map_texts(found, [*columns, *out], _columns(b), _searcher(shared))
        out += [f"__{c}_{b}" for c in ("words", "spans", "items", "longest")]
        if b + 1 < n:
            found = settle(found)
    passes = range(len(out) // 4)
    spans = [F.col(f"__spans_{b}") for b in passes]
    items = [F.col(f"__items_{b}") for b in passes]
    longest = [F.col(f"__longest_{b}") for b in passes]
    one = len(spans) == 1
    return found.select(
        *[named(c) for c in keep],
        F.col("__words_0").alias("__n_words"),
        (spans[0] if one else _merged(F.flatten(F.array(*spans)))).alias("__hits"),
        (items[0] if one else F.array_sort(F.array_distinct(F.flatten(F.array(*items))))).alias("__items"),
        (longest[0] if one else F.greatest(*longest)).alias("__longest"),
    )


def _n_hit():
    return F.aggregate("__hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def _contaminated():
    return (_n_hit() > 0) & (_n_hit() * SHARE >= F.col("__n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    rows = wrapped(docs, "doc_id", "text")
    found = contamination(rows, benchmark, rows.columns, window).where(~_contaminated())
    return unwrapped(found.select(*rows.columns), docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs, benchmark, ["doc_id"]).select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        _n_hit().alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_words(column: str) -> str:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{words}')"


_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM b WHERE len(w) > 0),
tests AS (
  SELECT DISTINCT item_id, k, array_to_string(w[o : o + k - 1], ' ') AS s
  FROM sized, unnest(range(1, len(w) - k + 2)) AS u(o)
),
lengths AS (SELECT DISTINCT k FROM tests),
grams AS (
  SELECT r, doc_id, k, o, array_to_string(w[o : o + k - 1], ' ') AS s
  FROM d, lengths, unnest(range(1, len(w) - k + 2)) AS u(o)
),
hits AS (SELECT g.r, g.k, g.o, t.item_id FROM grams g JOIN tests t ON g.k = t.k AND g.s = t.s),
places AS (SELECT r, count(DISTINCT p) AS n FROM hits, unnest(range(o, o + k)) AS u(p) GROUP BY r),
found AS (
  SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT i, ',' ORDER BY i) AS ids
  FROM (SELECT r, item_id, cast(item_id AS VARCHAR) AS i FROM hits) GROUP BY r
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256,
  coalesce(p.n, 0) > 0 AND {SHARE} * coalesce(p.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN places p USING (r) LEFT JOIN found f USING (r)
"""

QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES = {"op5_decontamination": _ORACLE}
