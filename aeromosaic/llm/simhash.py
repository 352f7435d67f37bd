"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits; the vector of their bit counts lies at a
Manhattan distance that never exceeds the number of differing bits. Counts are written in unary,
so that Manhattan distance is again a count of differing bits. The 32 dimensions are dealt into
``axes`` grid axes; vectors within distance ``bits`` agree on all but ``bits`` axes, so every link
is found in some cell of the grids that fix ``axes - bits`` of them. Inside a cell the bound is
tested first, then the fingerprints themselves.

Cells are streamed through sorted tasks. A small cell gives its links; a larger one the links of a
breadth-first walk, at most one for each member, which joins the same documents: copies with many
slightly different fingerprints cost rows in proportion, not in the square. All documents with the
same fingerprint are one node.

Null and empty texts have fingerprint zero and link like any other. Rows are nodes by fingerprint, so
repeated rows and ids share a component; null ids never name one unless all of its ids are null.
Empty tables give empty results; further columns are left out, or kept by ``one_of_each``.
"""

from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle
from aeromosaic.llm.components import components
from aeromosaic.llm.texts import map_texts, space_words, table, unwrapped, wrapped

SHINGLE, BITS, SEED = 4, 4, 42
LANES = 32  # two-bit segments
SMALL = 32  # members of a cell whose links are all given
OCCUPANCY = 8  # chance members of a cell that axes are chosen for
_CHUNK = 1 << 16  # hashes whose bits are unpacked at once
_LOW = 0x5555555555555555


def _hashes(text: str | None, k: int, digest) -> list[int]:
    words = space_words(text)
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= k:
        return [digest(line)]
    ends = list(accumulate(map(len, words), lambda at, size: at + 1 + size))
    starts = [0, *[e + 1 for e in ends[:-k]]]
    return [digest(line[a:b]) for a, b in zip(starts, ends[k - 1 :], strict=True)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return counts


def fingerprints(texts, k: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the shingle hashes."""
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    out = np.zeros(len(texts), np.uint64)
    for row, text in enumerate(texts):
        found = _hashes(text, k, digest)
        if found:
            counts = _bit_counts(np.array(found, np.uint64))
            out[row] = weights[counts * 2 > len(found)].sum(dtype=np.uint64)
    return out


def with_fingerprints(docs: DataFrame, keep: list[str], out: str, k: int = SHINGLE) -> DataFrame:
    def start():
        def work(column):
            return [pa.array(fingerprints(column.to_pylist(), k).view(np.int64))]

        return work

    return map_texts(docs, keep, f"`{out}` long", start)


def _unary(fp):
    """Per-segment counts in unary: 0, 1 and 2 are 00, 01 and 11."""
    low = F.lit(_LOW)
    half = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(half).bitwiseAND(low), fp.bitwiseAND(half).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def unary(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(_LOW), np.uint64(1)
    return ((fp | (fp >> one)) & low) | ((fp & (fp >> one) & low) << one)


def axis_count(n: int, bits: int) -> int:
    """Fewest axes for which a cell has few members by chance.

    Two random segments of two bits agree with probability 3/8. The least is three more than ``bits``.
    """
    axes = bits + 3
    while n * 0.375 ** (LANES * (axes - bits) / axes) > OCCUPANCY and axes < min(LANES, bits + 8):
        axes += 1
    return axes


def grid_masks(axes: int, bits: int) -> list[int]:
    """For every choice of the axes that agree, the bits of their segments, as signed numbers."""
    lanes = [[lane for lane in range(LANES) if lane % axes == a] for a in range(axes)]
    masks = []
    for chosen in combinations(range(axes), axes - bits):
        mask = sum(3 << 2 * lane for a in chosen for lane in lanes[a])
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _near(a, b, bits):
    """Manhattan distance first, as a lower bound, then the differing bits."""
    close = np.bitwise_count(unary(a) ^ unary(b)) <= bits
    close &= np.bitwise_count(a ^ b) <= bits
    return close


def _walk(members: np.ndarray, bits: int):
    """Links of a breadth-first walk over one cell: at most one for each member."""
    rest, out = members, []
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            front = queue.pop()
            for at in front:
                close = _near(rest, at, bits)
                if close.any():
                    new = rest[close]
                    out.append(np.stack([np.full(len(new), at), new], 1))
                    queue.append(new)
                    rest = rest[~close]
                    if not len(rest):
                        break
    return out


def _pairs(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int):
    """Links of small cells, all cells at once: each member with those a given step behind it."""
    out = []
    place = np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes)
    at, left = np.repeat(starts, sizes) + place, np.repeat(sizes, sizes) - place
    for step in range(1, int(sizes.max(initial=1))):
        a = at[left > step]
        close = _near(fp[a], fp[a + step], bits)
        out.append(np.stack([fp[a[close]], fp[a[close] + step]], 1))
    return out


def _cell_links(bits: int):
    def run(batches):
        held = None  # rows of the last cell, which may go on in the next batch
        for batch in batches:
            grid, cell, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            rows = np.stack([grid.astype(np.int64), cell, fp], 1)
            if held is not None:
                rows = np.concatenate([held, rows])
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            cut = int(new[-1]) if len(new) else 0
            held = rows[cut:]
            yield from links(rows[:cut])
        if held is not None:
            yield from links(held)

    def links(rows):
        if not len(rows):
            return
        bounds = np.r_[0, np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1, len(rows)]
        starts, sizes = bounds[:-1], np.diff(bounds)
        fp = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        small = (sizes > 1) & (sizes <= SMALL)
        found = _pairs(fp, starts[small], sizes[small], bits)
        for at, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            found += _walk(fp[at : at + size], bits)
        if found:
            pairs = np.unique(np.concatenate(found).view(np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that join all fingerprints (column ``fp``, distinct) at most ``bits`` apart."""
    axes = axis_count(prints.count(), bits)
    counts = _unary(F.col("fp"))
    cells = [
        F.struct(F.lit(g).alias("grid"), counts.bitwiseAND(F.lit(mask)).alias("cell"))
        for g, mask in enumerate(grid_masks(axes, bits))
    ]
    cells = prints.select("fp", F.explode(F.array(*cells)).alias("at")).select("at.grid", "at.cell", "fp")
    dealt = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell")
    return dealt.mapInArrow(_cell_links(bits), "a long, b long").distinct()


def classes(marked: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root, first_id, component_id) of every fingerprint of ``marked`` (doc_id, fp).

    ``root`` names the component by a fingerprint, ``first_id`` is the smallest id with the
    fingerprint, ``component_id`` the smallest reachable.
    """
    prints = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(prints.select("fp"), bits))
    labelled = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    names = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return labelled.join(names, "root").select("fp", "root", "first_id", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id of every document (columns doc_id and text)."""
    marked = settle(with_fingerprints(docs, ["doc_id"], "fp", shingle))
    found = classes(marked, bits).select("fp", "component_id")
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of each component, that of the smallest id, with all columns of the documents.

    Rows are numbered where they are written; which ones stay is settled on numbers, fingerprints and
    hashes, and texts are fetched once, for those.
    """
    rows = wrapped(docs, "doc_id", "text")
    marked = with_fingerprints(rows, rows.columns, "fp", shingle)
    marked = settle(marked.withColumn("__number", F.monotonically_increasing_id()))
    thin = marked.select("__number", "doc_id", "fp", F.xxhash64("text").alias("hash"))
    found = classes(thin.select("doc_id", "fp"), bits)
    best = F.min(F.struct(F.col("first_id").isNull(), "first_id", "fp")).alias("best")
    keepers = found.groupBy("root").agg(best).select(
        F.col("best.fp").alias("kept_fp"), F.col("best.first_id").alias("kept_id")
    )
    same = (F.col("fp") == F.col("kept_fp")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    first = F.min(F.struct("hash", "__number"))["__number"].alias("__number")
    kept = thin.join(keepers, same, "left_semi").groupBy("fp", "doc_id").agg(first).select("__number")
    return unwrapped(marked.join(kept, "__number", "left_semi").select(*rows.columns), docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
