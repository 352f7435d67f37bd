"""Spelling variants: words of one edit from each other, and the commonest form behind each.

Words are maximal runs of Latin letters. Counts are added up per task first. Two words of one edit
agree outside one part of the shorter one, so words meet under keys (length, part, the rest): halves
first, and a key that more than CROWD words share is split into the two halves of its part, down to
single letters, where the alphabet bounds it; no partner is lost. Words of a key stand
in a sorted list. The list is scanned with rows of the edit matrix, banded to the three cells that can
be at most one: a row is computed once for all words of a range with the same prefix and is carried
down to the ranges inside (those between the shared-prefix lengths of neighbours); a range whose
row has passed one edit is skipped. All scans of a batch advance one letter together. A
task sends on one row per word and key: number of near words and the commonest of them.

Null texts have no words; a null doc_id counts as an empty string in the hash that plants deletions.
Repeated rows count again; equal counts go to the smallest word; further columns change nothing; an
empty table gives an empty result.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle, settle_marked
from aeromosaic.llm.texts import named, table

LETTERS, OCCURRENCES, FACTOR = 5, 3, 2
PLANTED = 97  # one occurrence class in so many loses a letter
DISTINCT = 200_000  # words a task counts before it passes them on
#: Words under one key that are scanned together; more than the 8,192 or so that two free letters allow.
CROWD = 10_000
BATCH = 8_000  # words whose scans advance together

_ALPHABET = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
#: Latin-1: A-Z lower-cased, letters kept, all else to spaces.
_TO_RUNS = bytes((b + 32 if b < 0x5B else b) if b in set(_ALPHABET) else 0x20 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters of a text in Latin-1, A-Z lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(_TO_RUNS).split()


def _planted(start: int, run: bytes) -> bytes:
    """The run, or the run without one letter where its hash, begun with ``start``, asks for it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % PLANTED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, least: int = LETTERS, occurrences: int = OCCURRENCES, plant: bool = False
) -> DataFrame:
    """(word, n) of words with enough letters and occurrences; ``plant`` deletes letters by doc_id."""

    def counted(batches):
        found = {}

        def out():
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            for k, doc in enumerate(ids):
                start = zlib.crc32(b":" if doc is None else f"{doc}:".encode())
                for run, n in Counter(runs(texts[k].as_py())).items():
                    if len(run) >= least:
                        word = _planted(start, run) if plant else run
                        if len(word) >= least:
                            found[word] = found.get(word, 0) + n
                if len(found) > DISTINCT:
                    yield out()
                    found = {}
        if found:
            yield out()

    part = docs.select(named("doc_id").cast("string").alias("doc"), named("text").alias("text"))
    return (
        part.mapInArrow(counted, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= occurrences)
    )


def _keyed(parts: DataFrame) -> DataFrame:
    """Rows (word, n, base, level, part) with the letters outside their part as a key."""
    placed = parts.withColumns(
        {
            "low": F.expr("cast(base * part div shiftleft(1L, level) as int)"),
            "rest": F.expr("cast(base - base * (part + 1) div shiftleft(1L, level) as int)"),
        }
    )
    head = F.expr("left(word, low)")
    tail = F.expr("if(rest > 0, right(word, rest), '')")
    numbers = [F.col(c).cast("string") for c in ("base", "level", "part")]
    return placed.select(
        "word", "n", "base", "level", "part", "low",
        F.concat_ws(":", *numbers, head, tail).alias("key"),
    )


def _halves(rows: DataFrame) -> DataFrame:
    """The rows of crowded keys under the two halves of their part."""
    two = F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)).alias("part")
    return rows.select("word", "n", "base", (F.col("level") + 1).alias("level"), two)


def meeting_keys(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Every word under its keys, none of which has more than ``crowd`` words unless letters run out."""
    size = F.length("word")
    both = F.explode(F.array(size - 1, size).cast("array<long>")).alias("base")
    start = words.select("word", "n", both, F.lit(0).alias("level"), F.lit(0).cast("long").alias("part"))
    open_rows, closed = _keyed(_halves(start)), []
    while True:
        # a part of one letter or none can't be split
        wide = F.expr("base > shiftleft(1L, level)")
        crowded = settle(
            open_rows.where(wide).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > crowd).select("key")
        )
        if crowded.isEmpty():
            closed.append(open_rows)
            break
        closed.append(open_rows.join(crowded, "key", "left_anti"))
        open_rows = settle(_keyed(_halves(open_rows.join(crowded, "key", "left_semi"))))
    rows = closed[0]
    for more in closed[1:]:
        rows = rows.unionByName(more)
    return rows


def near_pairs(words: list[bytes], groups: np.ndarray, base: np.ndarray, low: np.ndarray):
    """Places (a, b), a < b, of words of one group at one edit; words are sorted within groups.

    ``groups`` rises; words of a group share their first ``low`` letters and have ``base`` letters or
    one more, at least one of a pair ``base``.
    """
    count = len(words)
    size = np.array([len(w) for w in words], np.int64)
    # two fillers before and after each word, so that the band never leaves it
    flat = np.frombuffer(b"\0\0" + b"".join(w + b"\0\0\0\0" for w in words), np.uint8)
    at = np.concatenate([[2], 2 + np.cumsum(size + 4)[:-1]])
    shared = np.zeros(count + 1, np.int64)  # letters shared with the word before; -1 at a group's start
    live = np.arange(1, count)
    depth = 0
    while len(live):
        same = flat[at[live] + depth] == flat[at[live - 1] + depth]
        live = live[same & (size[live] > depth)]
        depth += 1
        shared[live] = depth
    first = np.append(True, groups[1:] != groups[:-1])
    shared[:count][first] = -1
    shared[count] = -1
    starts = np.nonzero(first)[0]
    ends = np.append(starts[1:], count)
    group = np.cumsum(first) - 1
    # every word scans the list of its own group from the letters that all of it shares
    some = np.nonzero((ends - starts)[group] > 1)[0]
    begin = low[some]
    pairs = []
    q = np.zeros(0, np.int64)
    lo, hi, r0, r1, r2 = (np.zeros(0, np.int64) for _ in range(5))
    alive = np.arange(count)
    depth = int(begin.min()) if len(some) else 0
    waiting = some[np.argsort(begin, kind="stable")]
    begin = np.sort(begin)
    used = 0
    while len(q) or used < len(waiting):
        if not len(q) and begin[used] > depth:
            depth = int(begin[used])
        upto = np.searchsorted(begin, depth, "right")
        if upto > used:
            new = waiting[used:upto]
            used = upto
            one = np.ones(len(new), np.int64)
            q = np.concatenate([q, new])
            lo, hi = np.concatenate([lo, starts[group[new]]]), np.concatenate([hi, ends[group[new]]])
            r0, r1, r2 = np.concatenate([r0, one]), np.concatenate([r1, 0 * one]), np.concatenate([r2, one])
        # a word that ends here is the first of its range
        done = (size[lo] == depth) & (lo > q)
        if done.any():
            gap = size[q[done]] - depth
            last = np.select([gap == 0, gap == -1, gap == 1], [r1[done], r0[done], r2[done]], 9)
            hit = (last == 1) & (size[lo[done]] + size[q[done]] <= 2 * base[q[done]] + 1)
            pairs.append(np.stack([q[done][hit], lo[done][hit]], 1))
        alive = alive[size[alive] > depth]
        heads = alive[shared[alive] <= depth]
        bounds = np.nonzero(shared <= depth)[0] if len(heads) else np.zeros(0, np.int64)
        left = np.searchsorted(heads, np.maximum(lo, 0))
        right = np.searchsorted(heads, hi)
        many = right - left
        child = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own = np.repeat(np.arange(len(q)), many)
        lo2 = heads[child]
        hi2 = np.minimum(bounds[np.searchsorted(bounds, lo2, "right")], hi[own]) if len(lo2) else lo2
        later = hi2 - 1 > q[own]  # a pair is found from its first word
        own, lo2, hi2 = own[later], lo2[later], hi2[later]
        letter, word = flat[at[lo2] + depth], at[q[own]] + depth
        b0, b1, b2 = r0[own], r1[own], r2[own]
        n0 = np.minimum(b0 + (flat[word - 1] != letter), b1 + 1)
        n1 = np.minimum(np.minimum(b1 + (flat[word] != letter), b2 + 1), n0 + 1)
        n2 = np.minimum(b2 + (flat[np.minimum(word + 1, len(flat) - 1)] != letter), n1 + 1)
        keep = np.minimum(np.minimum(n0, n1), n2) <= 1
        # beyond the end of the scanning word by more than one letter nothing can match
        keep &= depth <= size[q[own]]
        q, lo, hi, r0, r1, r2 = (x[keep] for x in (q[own], lo2, hi2, n0, n1, n2))
        depth += 1
    found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    return found, flat, at, size


def _first_key(found, flat, at, size, base, level, part):
    """Which pairs are at the first of the keys that both words share."""
    a, b = found[:, 0], found[:, 1]
    tail = np.zeros(len(found), np.int64)
    live = np.arange(len(found))
    depth = 0
    while len(live):
        same = flat[at[a[live]] + size[a[live]] - 1 - depth] == flat[at[b[live]] + size[b[live]] - 1 - depth]
        same &= (size[a[live]] > depth) & (size[b[live]] > depth)
        live = live[same]
        depth += 1
        tail[live] = depth
    # the part before this one, if there is one, ends where the shared tail would have to begin
    length, step, own = base[a], level[a], part[a]
    before = (length * own) >> step
    return (own == 0) | (length - tail > before)


def _scan(batches):
    """Per word and key that has near words: their number, and the commonest (ties: the smallest)."""

    def worked(table):
        words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        n, base, level, part, low = (
            table.column(c).to_numpy().astype(np.int64) for c in ("n", "base", "level", "part", "low")
        )
        keys = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        found, flat, at, size = near_pairs(words, keys, base, low)
        found = found[_first_key(found, flat, at, size, base, level, part)]
        both = np.concatenate([found, found[:, ::-1]])
        # the near word of the largest count, then the smallest, comes first; words are sorted in a key
        order = np.lexsort((both[:, 1], -n[both[:, 1]], both[:, 0]))
        both = both[order]
        head = np.append(True, both[1:, 0] != both[:-1, 0]) if len(both) else np.zeros(0, bool)
        place = np.nonzero(head)[0]
        word, near = both[place, 0], both[place, 1]
        text = table.column("word").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                text.take(pa.array(word)),
                pa.array(n[word]),
                pa.array(np.diff(np.append(place, len(both)))),
                pa.array(n[near]),
                text.take(pa.array(near)),
            ],
            ["word", "n", "n_near", "best_n", "best"],
        )

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BATCH:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        low = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if low:
            yield worked(whole.slice(0, low).combine_chunks())
        held = whole.slice(low).to_batches()
        rows -= low
    if rows:
        yield worked(pa.Table.from_batches(held).combine_chunks())


def variants(words: DataFrame, factor: int = FACTOR, crowd: int = CROWD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row (word, n) of distinct words."""
    words = settle(words)
    columns = ["key", "word", "n", "base", "level", "part", "low"]
    lists = meeting_keys(words, crowd).select(*columns).repartition("key").sortWithinPartitions("key", "word")
    near = lists.mapInArrow(_scan, "word string, n long, n_near long, best_n long, best string")
    alone = words.select(
        "word", "n", F.lit(0).cast("long").alias("n_near"),
        F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"),
    )
    best = F.when(F.col("best").isNotNull(), F.struct(-F.col("best_n"), F.col("best")))
    merged = near.union(alone).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("first")
    )
    form_n = -F.col("first")["col1"]
    ruling = form_n >= factor * F.col("n")
    forms = settle(
        merged.select(
            "word", "n", "n_near",
            F.when(ruling, F.col("first")["best"]).alias("form"),
            F.when(ruling, form_n).alias("form_n"),
        )
    )
    return _rooted(forms)


def _rooted(forms: DataFrame) -> DataFrame:
    """Forms followed to their end; jumps double in length each round, since counts rise along them."""
    jumps, moved = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), True
    while moved:
        jumps = settle(jumps)
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps, (moved,) = settle_marked(
            jumps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"),
            F.count("next"),
        )
        jumps = jumps.drop("next")
    return forms.join(jumps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents"), plant=True)
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op13_spelling": op13_spelling}
ORACLES: dict[str, str] = {}
