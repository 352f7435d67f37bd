"""Language-model scores: prediction by partial matching over bytes, beside a word unigram.

The trie of the training texts holds every context of up to ORDER bytes. A symbol costs its share
among the symbols of the longest context seen, or else an escape (method C: as many escapes as
distinct symbols) and its share one byte shorter, where the symbols of the longer context are
excluded; below the empty context all symbols left are alike. The cost of a symbol depends only on
its ORDER bytes of context, so a text's code length is a sum over its (ORDER + 1)-grams.

Texts are dealt to blocks, which are read twice: once to count, each block giving its distinct grams
and words with their number in training texts, once to score. In between the trie is made: nodes are
grouped by the last two bytes of their context, which share all suffixes down to those; one- and
two-byte nodes (at most 256 * 257) go to every task. Costs come back to each block for the grams that
it has, and word counts where they differ from its own (a block may hand a gram or word on in several
rows, which then come back as several equal ones). No task holds more than a block or the nodes
of a two-byte context.

A null text counts as empty: only its end is scored. Rows are scored one by one, so repeated rows and
null ids do no harm; without training texts all symbols are alike. A very long text is encoded in
parts. An empty table gives an empty result; further columns are left out.
"""

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle
from aeromosaic.llm.texts import table

ORDER = 4
BLOCK_BYTES = 32 << 20  # UTF-8 bytes of the texts of a block
START, END = 0xFF, 0xFE  # bytes that UTF-8 never has: before a text, and its last symbol
SYMBOLS = 257  # all bytes and the end
_PART = 1 << 20  # symbols coded at once
_WIDTH = 8 * (ORDER + 1)
_ROOMS = 1 << (64 - _WIDTH)  # texts told apart while their grams are sorted
_FLUSH = 800_000  # distinct grams and words held in a task before they are handed on
_TWO = 256 * 256


def gram_codes(text: bytes, start: int, stop: int) -> np.ndarray:
    """Codes of the (ORDER + 1)-grams that end at symbols start..stop of a text and its end."""
    before = text[max(0, start - ORDER) : start].rjust(ORDER, bytes([START]))
    here = text[start:stop] + (bytes([END]) if stop > len(text) else b"")
    a = np.frombuffer(before + here, np.uint8).astype(np.uint64)
    codes = a[: len(here)].copy()
    for k in range(1, ORDER + 1):
        codes = (codes << np.uint64(8)) | a[k : k + len(here)]
    return codes


def _parts(texts):
    """(rows, codes) of groups of texts with about _PART symbols; a long text comes in several."""
    rows, codes, size = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) + 1, _PART):
            codes.append(gram_codes(text, at, min(at + _PART, len(text) + 1)))
            rows.append(np.full(len(codes[-1]), row, np.uint64))
            size += len(codes[-1])
            if size >= _PART:
                yield np.concatenate(rows), np.concatenate(codes)
                rows, codes, size = [], [], 0
    if codes:
        yield np.concatenate(rows), np.concatenate(codes)


class _Counts:
    """Distinct grams and words of one block, with their number in training texts."""

    def __init__(self):
        self.grams, self.fresh = np.zeros((2, 0), np.int64), []
        self.words: Counter = Counter()
        self.size = 0

    def add(self, text: bytes, learn: bool):
        for at in range(0, len(text) + 1, _PART):
            codes = gram_codes(text, at, min(at + _PART, len(text) + 1))
            self.fresh.append((codes << np.uint64(1)) | np.uint64(learn))
            self.size += len(codes)
        words = text.lower().split()
        if learn:
            self.words.update(words)
        else:
            for w in set(words):
                self.words.setdefault(w, 0)
        if self.size >= _PART:
            self.pack()

    def pack(self):
        if not self.fresh:
            return
        codes = np.concatenate(self.fresh)
        codes.sort()
        grams, learn = (codes >> np.uint64(1)).astype(np.int64), (codes & np.uint64(1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        new = np.stack([grams[first], np.add.reduceat(learn, first)])
        both = np.concatenate([self.grams, new], 1)
        both = both[:, both[0].argsort(kind="stable")]
        first = np.flatnonzero(np.r_[True, both[0, 1:] != both[0, :-1]])
        self.grams = np.stack([both[0, first], np.add.reduceat(both[1], first)])
        self.fresh, self.size = [], 0


_COUNTED = "block long, gram long, word binary, n long"


def _count(batches):
    blocks: dict[int, _Counts] = {}

    def handed_on():
        for block, counts in blocks.items():
            counts.pack()
            n = counts.grams.shape[1]
            words = list(counts.words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + len(words), block)),
                    pa.concat_arrays([pa.array(counts.grams[0]), pa.nulls(len(words), pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(words, pa.binary())]),
                    pa.concat_arrays(
                        [pa.array(counts.grams[1]), pa.array(list(counts.words.values()), pa.int64())]
                    ),
                ],
                ["block", "gram", "word", "n"],
            )
        blocks.clear()

    for batch in batches:
        texts, learn, place = (batch.column(c).to_pylist() for c in range(3))
        for text, learns, block in zip(texts, learn, place, strict=True):
            blocks.setdefault(block, _Counts()).add((text or "").encode(), learns)
        if sum(len(c.words) + c.grams.shape[1] for c in blocks.values()) > _FLUSH:
            yield from handed_on()
    yield from handed_on()


def _symbol_sums(keys, n):
    """(key, sum) of each distinct key."""
    order = keys.argsort(kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def _lookup(keys, values, wanted):
    """Value of each wanted key in a sorted list, 0 where it has none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Levels:
    """Counts of the grams of some lengths: of each gram, and by context its total, its distinct
    symbols, and how often these come one byte shorter, which exclusion takes away."""

    def __init__(self):
        self.count, self.total, self.kinds, self.shorter = {}, {}, {}, {}

    def add(self, j: int, keys: np.ndarray, n: np.ndarray):
        """Grams with j bytes of context; those with fewer come first."""
        self.count[j] = keys, n
        if not len(keys):
            self.total[j] = self.kinds[j] = self.shorter[j] = (keys, n)
            return
        self.total[j] = _symbol_sums(keys >> 8, n)
        self.kinds[j] = _symbol_sums(keys >> 8, np.ones_like(n))
        if j:
            below = _lookup(*self.count[j - 1], keys & ((1 << 8 * j) - 1))
            self.shorter[j] = _symbol_sums(keys >> 8, below)

    def above(self, grams: np.ndarray, n: np.ndarray) -> "Levels":
        """The longer levels of one set of grams, with these below."""
        out = Levels()
        for name in ("count", "total", "kinds", "shorter"):
            getattr(out, name).update(getattr(self, name))
        sums = {ORDER: (grams[n > 0], n[n > 0])}
        for j in range(ORDER - 1, 1, -1):
            keys, counts = sums[j + 1]
            sums[j] = _symbol_sums(keys & ((1 << 8 * (j + 1)) - 1), counts) if len(keys) else sums[j + 1]
        for j in range(2, ORDER + 1):
            out.add(j, *sums[j])
        return out

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each gram after the others."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))  # grams whose symbol isn't found yet
        longer = np.zeros(len(grams), bool)  # whether a longer context was seen
        for j in range(ORDER, -1, -1):
            part = grams[left] & ((1 << 8 * (j + 1)) - 1)
            n = _lookup(*self.count[j], part)
            total = _lookup(*self.total[j], part >> 8)
            kinds = _lookup(*self.kinds[j], part >> 8)
            if j < ORDER:
                above = (grams[left] & ((1 << 8 * (j + 2)) - 1)) >> 8
                was = longer[left]
                total = total - np.where(was, _lookup(*self.shorter[j + 1], above), 0)
                kinds = kinds - np.where(was, _lookup(*self.kinds[j + 1], above), 0)
            escapes = kinds
            if j == 0 and len(self.count[0][0]) == SYMBOLS:
                escapes = np.zeros_like(kinds)  # nothing to escape to
            some = total + escapes > 0
            hit = n > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.log10(np.where(hit, n, escapes)) - np.log10(total + escapes)
            out[left] += np.where(some, step, 0.0)
            longer[left] |= _lookup(*self.kinds[j], part >> 8) > 0
            left = left[~hit]
        out[left] -= np.log10(max(1, SYMBOLS - len(self.count[0][0])))
        return out


def _low_levels(pairs: list[tuple[int, int]]) -> Levels:
    """The levels of no and one byte of context, from counts of two-byte grams."""
    keys, n = (np.array([r[k] for r in pairs], np.int64) for k in (0, 1))
    low = Levels()
    low.add(0, *(_symbol_sums(keys & 0xFF, n) if len(keys) else (keys, n)))
    low.add(1, keys, n)
    return low


def _costs(low: Levels):
    def run(key, rows):
        grams, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
        order = grams.argsort()
        grams, n = grams[order], n[order]
        cost = low.above(grams, n).cost(grams)
        return pa.table({"gram": grams, "cost": cost})

    return run


def gram_costs(grams: DataFrame) -> DataFrame:
    """(gram, cost) of every gram of a table (gram, n), which holds the trie in its n."""
    two = grams.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit(_TWO - 1)).alias("pair"))
    rows = sorted(tuple(r) for r in two.agg(F.sum("n")).collect())  # at most 256 * 257 rows
    context = F.shiftright("gram", 8).bitwiseAND(F.lit(_TWO - 1)).alias("context")
    return grams.select(context, "gram", "n").groupBy("context").applyInArrow(
        _costs(_low_levels(rows)), "gram long, cost double"
    )


def _scorer(key, docs, back):
    """Sums of one block: its texts against the costs and counts that came back to it."""
    gram, cost, word, count = (back.column(c) for c in ("gram", "cost", "word", "n"))
    is_gram = np.asarray(gram.is_valid())
    codes = gram.filter(pa.array(is_gram)).to_numpy().astype(np.uint64)
    costs = cost.filter(pa.array(is_gram)).to_numpy()
    order = codes.argsort()
    codes, costs = codes[order], costs[order]
    words = pa.array(~is_gram)
    elsewhere = dict(zip(word.filter(words).to_pylist(), count.filter(words).to_pylist(), strict=True))

    texts = [(t or "").encode() for t in docs.column("text").to_pylist()]
    learns = docs.column("learns").to_pylist()
    score = np.zeros(len(texts))
    for at in range(0, len(texts), _ROOMS):
        some = texts[at : at + _ROOMS]
        for rows, found in _parts(some):
            packed = (found << np.uint64(64 - _WIDTH)) | rows
            packed.sort()
            here = packed >> np.uint64(64 - _WIDTH)
            first = np.r_[True, here[1:] != here[:-1]]
            mine = costs[np.searchsorted(codes, here[first])]
            owner = (packed & np.uint64(_ROOMS - 1)).astype(np.int64)
            score[at : at + len(some)] += np.bincount(owner, mine[first.cumsum() - 1], len(some))

    own: Counter = Counter()
    for text, learn in zip(texts, learns, strict=True):
        if learn:
            own.update(text.lower().split())
    dict.update(own, elsewhere)
    n_tokens, n_known, base = [], [], []
    for text in texts:
        tokens = text.lower().split()
        counts = np.fromiter(map(own.get, tokens, repeat(0)), np.int64, len(tokens))
        n_tokens.append(len(tokens) + 1)
        n_known.append(int((counts > 0).sum()))
        base.append(float(np.log10(counts + 1.0).sum()))
    return pa.table(
        {
            "doc_id": docs.column("doc_id"), "learns": docs.column("learns"),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "base": pa.array(base, pa.float64()), "score": pa.array(score),
        }
    )


def scores(docs: DataFrame, learns: Column, place: list[Column] | None = None) -> DataFrame:
    """doc_id, learns, n_tokens, n_known, train_tokens, base_score and score of every text.

    ``learns`` marks the training texts. ``place`` tells where rows lie, so that the counting pass
    finds the texts of a block together; each place should hold a few blocks at most.
    """
    marked = docs.select("doc_id", "text", F.coalesce(learns, F.lit(False)).alias("learns"), *(place or []))
    places = [c for c in marked.columns if c not in ("doc_id", "text", "learns")]
    sizes = marked.groupBy(*places).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))
    (most,) = sizes.agg(F.max(F.coalesce("bytes", F.lit(0)) + F.col("n"))).first()
    parts = -(-(most or 1) // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    block = F.xxhash64(*places, part) if places else part.cast("long")
    texts = marked.select("doc_id", "text", "learns", block.alias("block"))

    counted = settle(texts.select("text", "learns", "block").mapInArrow(_count, _COUNTED))
    grams = counted.where("gram IS NOT NULL").select("block", "gram", "n")
    words = counted.where("gram IS NULL").select("block", "word", "n")
    costs = gram_costs(settle(grams.groupBy("gram").agg(F.sum("n").alias("n"))))
    # a word's rows are at most one or a few from each block, so they may meet in one task
    same = Window.partitionBy("word")
    place, c = F.row_number().over(same.orderBy("block")), F.sum("n").over(same)
    summed = words.select("block", "word", "n", c.alias("c"), place.alias("place"))
    seen = Observation()
    known_first = F.count_if((F.col("place") == 1) & (F.col("c") > 0))
    summed = summed.observe(seen, F.sum("n").alias("n"), known_first.alias("v"))
    elsewhere = settle(summed.where("c <> n").select("block", "word", "c"))
    ends = marked.agg(F.count_if("learns")).first()[0]
    n, v = (seen.get["n"] or 0) + ends, seen.get["v"] + (ends > 0)

    nothing = F.lit(None)
    back = grams.join(costs, "gram").select(
        "block", "gram", "cost", nothing.cast("binary").alias("word"), nothing.cast("long").alias("n")
    )
    back = back.union(
        elsewhere.select("block", nothing.cast("long"), nothing.cast("double"), "word", "c")
    )
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, learns boolean, n_tokens long, n_known long, base double, score double"
    scored = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scorer, schema)
    end = np.log10(ends + 1)
    return scored.select(
        "doc_id",
        "learns",
        "n_tokens",
        (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(float(end)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias(
            "base_score"
        ),
        "score",
    )


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    found = scores(docs, ~held_out, place)
    return found.select(
        "doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


QUERIES = {"op10_ppm": op10_ppm}
ORACLES: dict[str, str] = {}
