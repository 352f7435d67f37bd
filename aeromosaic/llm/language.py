"""Language identification by nearest centroids.

A text becomes counts of byte n-grams (1 to 3 bytes of its lower-cased words) hashed into DIM
dimensions, weighted by log frequency and inverse document frequency and scaled to length one.
Each language has several centroids (spherical k-means). A text gets the language of the centroid
with the largest cosine and is rejected if that is below what texts of about its length reach.

Document frequencies are counted over all labelled texts. Centroids are fitted on at most SAMPLE
labelled texts a language, those with the smallest hash of id and text: this bound is the only
sampling. The model has a few centroids for each language and no part that grows with the texts.

A null text, and one without a letter, is ``und``, has score 0 and is rejected; without any labelled
text so is every text. Ties go to the language that sorts first. Very long texts are read whole;
repeated rows are judged alike; empty tables and further columns of any name are fine.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle, top_n
from aeromosaic.llm.texts import map_texts, table, unwrapped, wrapped

DIM_BITS = 12
DIM = 1 << DIM_BITS
SAMPLE = 2000  # labelled texts that a language's centroids are fitted on
CENTROIDS = 4
ROUNDS = 12
MARGIN = 0.5  # a text is rejected below this share of the median cosine of its length class
LEAST = 0.02  # or below this cosine, whatever its length
UNKNOWN = "und"
_CLASSES = 24  # classes of length: powers of two of the number of n-grams
_ROWS = 256
_NON_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str | None) -> np.ndarray:
    """Hashed n-gram counts of a text."""
    words = (text or "").lower().encode().translate(_NON_LETTERS).split()
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    two = (a[:-1] << np.uint32(8)) | a[1:]
    three = (two[:-1] << np.uint32(8)) | a[2:]
    mix, shift = np.uint32(2654435761), np.uint32(32 - DIM_BITS)
    n = np.zeros(DIM, np.int64)
    for k, grams in enumerate((a[a != 32], two, three), 1):
        place = ((grams + np.uint32(k << 24)) * mix) >> shift
        n += np.bincount(place, minlength=DIM)
    return n


def vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit vectors of n-gram counts; a text without any stays zero."""
    v = np.log1p(counts).astype(np.float32) * weights
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(1), 1)).astype(np.int64), _CLASSES - 1)


@dataclass
class Model:
    langs: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    weights: np.ndarray
    floors: np.ndarray  # least cosine by language and length class

    def predict(self, texts):
        """(language, cosine, rejected) of each text."""
        for at in range(0, len(texts), _ROWS):
            part = texts[at : at + _ROWS]
            counts = np.stack([gram_counts(t) for t in part])
            if not self.langs:
                yield from [(UNKNOWN, 0.0, True)] * len(part)
                continue
            cosine = vectors(counts, self.weights) @ self.centroids.T
            best = cosine.argmax(1)  # centroids are ordered by language
            score = cosine[np.arange(len(part)), best]
            floor = self.floors[self.owner[best], _length_class(counts)]
            for text, b, s, f in zip(part, best, score, floor, strict=True):
                if has_letter(text):
                    yield self.langs[self.owner[b]], min(max(float(s), 0.0), 1.0), bool(s < f)
                else:
                    yield UNKNOWN, 0.0, True


def _frequencies(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that have each dimension, over all labelled texts, added up in each task first."""

    def run(batches):
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += gram_counts(text) > 0
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, DIM)), pa.array(np.r_[n, seen])], ["dim", "n"]
        )

    counted = labelled.select("text").mapInArrow(run, "dim long, n long")
    rows = counted.groupBy("dim").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows
    found = dict.fromkeys(range(-1, DIM), 0) | {r["dim"]: r["n"] for r in rows}
    return np.array([found[d] for d in range(DIM)], np.float64), found[-1]


def _sample(labelled: DataFrame, size: int) -> DataFrame:
    """At most ``size`` distinct texts of each language, by the smallest hash of id and text.

    Only hashes are counted and ranked; texts are fetched for the chosen ones and no others are shuffled.
    """
    hashed = labelled.withColumn("__order", F.xxhash64("doc_id", "text"))
    thin = settle(hashed.select("lang", "__order").distinct())
    counts = thin.groupBy("lang").count()
    # first about twice as many by their hash alone, so that only those are ranked
    share = (F.col("__order") / F.lit(2.0**64)) + 0.5
    near = thin.join(F.broadcast(counts), "lang")
    near = near.where((F.col("count") <= 4 * size) | (share * F.col("count") < 2 * size))
    chosen = top_n(near.select("lang", "__order"), ["lang"], ["__order"], size, "__rank").drop("__rank")
    fetched = hashed.join(F.broadcast(chosen), ["lang", "__order"], "left_semi")
    return fetched.groupBy("lang", "__order").agg(F.max("text").alias("text"))


def _cluster(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from spread starts; the same rows always give the same centroids."""
    starts = [v.mean(0)]
    for _ in range(min(k, len(v))):
        near = np.max(v @ np.stack(starts).T, axis=1)
        starts.append(v[int(near.argmin())])
    c = np.stack(starts[1:])
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        sums = np.stack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _floors(cosine: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Least cosine accepted in each length class; a class with few texts takes the next shorter,
    or, if there is none, that of the shortest texts. Medians, so that a few odd rows don't lower it."""
    floors, last = np.full(_CLASSES, LEAST), LEAST
    for k in range(_CLASSES):
        if k == classes.min() and len(classes) >= 5:
            shortest = np.argsort(classes, kind="stable")[:20]
            last = max(LEAST, MARGIN * float(np.median(cosine[shortest])))
        here = cosine[classes == k]
        if len(here) >= 20:
            last = max(LEAST, MARGIN * float(np.median(here)))
        floors[k] = last
    return floors


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from a table of doc_id, text and lang; rows without a language or a letter don't count."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = _frequencies(labelled)
    weights = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def train(key, rows):
        counts = np.stack([gram_counts(t) for t in rows["text"] if has_letter(t)] or [np.zeros(DIM)])
        if not counts.any():
            return pd.DataFrame({"lang": [], "centroids": [], "floors": []})
        v = vectors(counts, weights)
        c = _cluster(v, centroids, ROUNDS)
        floors = _floors((v @ c.T).max(1), _length_class(counts))
        return pd.DataFrame(
            {"lang": [key[0]], "centroids": [c.astype(np.float32).tobytes()], "floors": [floors.tobytes()]}
        )

    fitted = (
        _sample(labelled.select("doc_id", "text", "lang"), sample)
        .select("lang", "text")
        .groupBy("lang")
        .applyInPandas(train, "lang string, centroids binary, floors binary")
    )
    rows = sorted(fitted.collect(), key=lambda r: r["lang"])
    parts = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIM) for r in rows]
    return Model(
        [r["lang"] for r in rows],
        np.repeat(np.arange(len(rows)), [len(p) for p in parts]).astype(np.int64),
        np.concatenate(parts) if parts else np.zeros((0, DIM), np.float32),
        weights,
        np.stack([np.frombuffer(r["floors"]) for r in rows]) if rows else np.zeros((0, _CLASSES)),
    )


def identify(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """``keep`` columns, __lang, __score and __rejected of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = shared.value

        def work(column):
            found = list(known.predict(column.to_pylist()))
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

        return work

    return map_texts(docs, keep, "__lang string, __score double, __rejected boolean", start)


def known_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not rejected by a model of their own labels, with their own columns."""
    rows = wrapped(docs, "doc_id", "text", "lang")
    found = identify(rows, rows.columns, fit(rows, sample)).where("NOT __rejected")
    return unwrapped(found.select(*rows.columns), docs.columns)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return identify(docs, ["doc_id"], model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"),
        F.col("__rejected").alias("rejected"),
    )


QUERIES = {"op9_language": op9_language}
ORACLES: dict[str, str] = {}
