"""Soft-membership mixing: documents get rates whose expected domain tokens meet target weights.

A softmax classifier learned from the table of labels gives every document posteriors over the domains
``high``, ``low`` (quality) and ``toxic``. Rates r >= 0 minimise

    1/2 sum_k ((sum_d r_d n_d p_dk - t_k) / N)^2 / s_k + PULL / 2 sum_d n_d / N (r_d - 1)^2

with n_d tokens, posteriors p_dk, targets t_k, N tokens in all and s_k the share that domain k has of
them, so that a rare domain counts as much as a common one. Projected gradient steps with the
projection taken last: l adds up the gradients of the domains, the rates are 1 - p_d . l where that is not
negative, else 0. Since posteriors sum to one, steps of length one can't overshoot. Accelerated, they go on until
every domain's condition holds within TOLERANCE of its share; if ROUNDS steps don't get there, a
warning tells what is left. Each step is one aggregate over a small table of numbers; only sums of the
domains reach the driver.

The classifier is fitted on at most SAMPLE labelled documents, those with the smallest hash of their
id; this bound is the only sampling. A document with several labels is toxic if any says so and of
high quality if all do; rows with null labels, and of unknown ids, teach nothing. Without labels the
posteriors are uniform. Null and empty texts have no tokens and are judged by their (missing) words.
Repeated rows are mixed one by one; empty tables and further columns of any name are fine.
"""

import pickle
import string
import warnings
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle, top_n
from aeromosaic.llm.texts import letter_words, map_texts, table, unwrapped, wrapped

DOMAINS = ["high", "low", "toxic"]
#: Share of tokens of each domain after mixing.
TARGETS: dict[str, float | None] = {"high": 0.75, "low": 0.25, "toxic": 0.0}
#: None: the share that the domain has among those without a target.
NATURAL: dict[str, float | None] = {"high": None, "low": None, "toxic": 0.0}
SAMPLE = 10_000  # labelled documents that the classifier is fitted on
VOCABULARY = 600  # words that tell domains apart
LEAST_DOCS = 5
STEPS, RATE, DECAY = 200, 2.0, 1e-4
PULL = 1e-2  # a domain misses its target by about this much of its share
ROUNDS, TOLERANCE = 400, 1e-6  # the residual left is relative to each domain's share
NOISE = 1e-12  # of rounding
_CAPITALS, _DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
_MARKS, _SPACES = string.punctuation.encode(), string.whitespace.encode()
_STYLES = 7


def style(text: str | None, words: list[bytes], distinct: set[bytes]) -> np.ndarray:
    """Shape of a text: shares of capitals, marks and digits (ASCII), repeated words, lengths."""
    data = (text or "").encode()
    n, w = max(len(data), 1), max(len(words), 1)

    def count(kind):
        return len(data) - len(data.translate(None, kind))

    capitals, marks, digits, spaces = map(count, (_CAPITALS, _MARKS, _DIGITS, _SPACES))
    letters = max(len(data) - marks - digits - spaces, 1)
    return np.array(
        [
            capitals / letters,
            marks / n,
            digits / n,
            1 - len(distinct) / w,
            np.log1p(len(words)) / 10,
            letters / w / 10,
            letters / n,
        ]
    )


@dataclass
class Classifier:
    words: dict[bytes, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # words, styles and a constant by domain

    def features(self, texts):
        """Word presence, standardised style and a constant, and the number of words, of each text."""
        x = np.zeros((len(texts), len(self.words) + _STYLES + 1))
        n = np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts):
            words = letter_words(text)
            n[row] = len(words)
            distinct = set(words)
            x[row, [self.words[w] for w in distinct.intersection(self.words)]] = 1.0
            x[row, -_STYLES - 1 : -1] = style(text, words, distinct)
        x[:, -_STYLES - 1 : -1] = (x[:, -_STYLES - 1 : -1] - self.mean) / self.scale
        x[:, -1] = 1.0
        return x, n

    def posteriors(self, x):
        z = x @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def learn(words: list[str], raw: np.ndarray, y: np.ndarray) -> Classifier:
    """Softmax regression on raw features of documents by accelerated gradient steps."""
    model = _unfitted(words)
    x = raw.astype(np.float64)
    styles = x[:, -_STYLES - 1 : -1]
    model.mean, model.scale = styles.mean(0), np.maximum(styles.std(0), 1e-6)
    x[:, -_STYLES - 1 : -1] = (styles - model.mean) / model.scale
    x, target = x.astype(np.float32), np.eye(len(DOMAINS), dtype=np.float32)[y]
    model.weights = ahead = np.zeros((x.shape[1], len(DOMAINS)), np.float32)
    step = RATE * 4 / max(1.0, float((x * x).sum(1).mean()))
    for k in range(STEPS):
        z = x @ ahead
        z = np.exp(z - z.max(1, keepdims=True))
        slope = x.T @ (z / z.sum(1, keepdims=True) - target) / len(y) + DECAY * ahead
        new = ahead - step * slope
        ahead = new + k / (k + 3) * (new - model.weights)
        model.weights = new
    return model


def _unfitted(words: list[str]) -> Classifier:
    numbers = {w.encode(): k for k, w in enumerate(words)}
    return Classifier(numbers, np.zeros(_STYLES), np.ones(_STYLES), np.zeros((0, 0)))


def telling_words(rows: DataFrame) -> list[str]:
    """The words whose presence in rows (text, domain) depends most on the domain, by chi-square."""
    sizes = {r["domain"]: r["m"] for r in rows.groupBy("domain").agg(F.count("*").alias("m")).collect()}
    total = sum(sizes.values())

    def present(batches):
        for batch in batches:
            seen = Counter()
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((w, k) for w in set(letter_words(text)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w.decode() for w, _ in seen], pa.string()),
                    pa.array([k for _, k in seen], pa.int32()),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                ["word", "domain", "n"],
            )

    n = [F.sum(F.when(F.col("domain") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in sizes]
    counted = rows.select("text", "domain").mapInArrow(present, "word string, domain int, n long").groupBy("word").agg(
        F.sum("n").alias("n"), *n
    )
    parts = [F.pow(F.col(f"n_{k}") - F.col("n") * (m / total), 2) / (F.col("n") * (m / total)) for k, m in sizes.items()]
    score = F.round(sum(parts, F.lit(0.0)), 9)
    best = counted.where(F.col("n") >= LEAST_DOCS).orderBy(score.desc(), "word").limit(VOCABULARY)
    return [r["word"] for r in best.select("word").collect()]


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain number) of every labelled id."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    one = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    return one.select("doc_id", domain.cast("int").alias("domain"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """The classifier, or None without labelled documents. Its parts are of fixed size."""
    order = F.xxhash64("doc_id").alias("order")
    some = labelled_domains(labels).select("doc_id", "domain", order, F.lit(0).alias("all"))
    some = top_n(some, ["all"], ["order", "doc_id"], sample, "rank").select("doc_id", "domain")
    # at most ``sample`` small rows, so they may be sent to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = settle(rows.dropDuplicates(["doc_id"]).select("text", "domain"))
    words = telling_words(rows)

    def features(batches):
        plain = _unfitted(words)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 512):
                x, _ = plain.features(texts[at : at + 512])
                offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(at, 512)], ["x", "domain"])

    def train(rows):
        model = learn(words, np.stack(rows["x"].to_numpy()), rows["domain"].to_numpy())
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    # one group of ``sample`` rows of fixed size, whatever the texts are
    seen = rows.mapInArrow(features, "x array<float>, domain int").withColumn("all", F.lit(0))
    fitted = seen.groupBy("all").applyInPandas(train, "model binary").collect()
    if not fitted:
        return None
    return pickle.loads(fitted[0]["model"])


def posteriors(docs: DataFrame, keep: list[str], model: Classifier | None) -> DataFrame:
    """``keep`` columns, __n_tokens and the posteriors __p_0, __p_1, ... of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = shared.value

        def work(column):
            texts, n, p = column.to_pylist(), [], []
            for at in range(0, len(texts), 512):
                part = texts[at : at + 512]
                if known is None:
                    n.append(np.array([len(letter_words(t)) for t in part]))
                    p.append(np.full((len(part), len(DOMAINS)), 1 / len(DOMAINS)))
                else:
                    x, count = known.features(part)
                    n.append(count)
                    p.append(known.posteriors(x))
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            p = np.concatenate(p) if p else np.zeros((0, len(DOMAINS)))
            return [pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(DOMAINS))]]

        return work

    columns = ", ".join(f"__p_{k} double" for k in range(len(DOMAINS)))
    return map_texts(docs, keep, f"__n_tokens long, {columns}", start)


def shares(targets: dict[str, float | None], natural: list[float]) -> list[float]:
    """Target shares of all domains, the open ones in their natural proportions; they sum to 1."""
    set_ = sum(w for w in targets.values() if w is not None)
    open_ = sum(n for d, n in zip(DOMAINS, natural, strict=True) if targets.get(d) is None)
    out = []
    for d, n in zip(DOMAINS, natural, strict=True):
        w = targets.get(d)
        out.append(w if w is not None else (1 - set_) * n / open_ if open_ else 0.0)
    total = sum(out)
    return [w / total if total else 0.0 for w in out]


def _rate(p: list, dual: list[float]):
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((x * F.lit(float(v)) for x, v in zip(p, dual, strict=True)), F.lit(0.0)))


def _gradients(scored: DataFrame, total: float, share: np.ndarray, aim: np.ndarray) -> list[float]:
    """The sum l of projected gradient steps on the rates, begun at rate 1 for all documents.

    Steps look ahead along the last one (Nesterov), and afresh where that led the wrong way.
    """
    p = [F.col(f"p_{k}") for k in range(len(DOMAINS))]
    weight = np.where(share > 0, 1 / np.maximum(share, 1e-300), 0)
    at = ahead = np.zeros(len(p))
    run = 0
    for _ in range(ROUNDS):
        held = scored.select((F.col("n_tokens") / F.lit(total)).alias("n"), *p, _rate(p, ahead).alias("rate"))
        sums = held.agg(*[F.sum(F.col("n") * F.col("rate") * x) for x in p]).first()
        left = weight * (np.array(sums) - aim) - PULL * ahead
        if (np.abs(left) <= TOLERANCE + NOISE * (weight * aim + PULL * np.abs(ahead))).all():
            return ahead.tolist()
        new = ahead + left / (1 + PULL)
        run = run + 1 if (share * left) @ (new - at) >= 0 else 0
        at, ahead = new, new + run / (run + 3) * (new - at)
    warnings.warn(f"mixing rates after {ROUNDS} steps: relative residuals {left.tolist()}", stacklevel=2)
    return at.tolist()


def _steps(scored: DataFrame, targets: dict[str, float | None]) -> list[float]:
    tokens = F.col("n_tokens").cast("double")
    first = scored.agg(F.sum(tokens), *[F.sum(tokens * F.col(f"p_{k}")) for k in range(len(DOMAINS))]).first()
    total, natural = first[0] or 0.0, [x or 0.0 for x in first[1:]]
    if not total:
        return [0.0] * len(DOMAINS)
    wanted = shares(targets, natural)
    # as many tokens as the domains that are wanted have now
    budget = sum(n for n, w in zip(natural, wanted, strict=True) if w > 0) / total
    return _gradients(scored, total, np.array(natural) / total, budget * np.array(wanted))


def solve(scored: DataFrame, targets: dict[str, float | None]) -> DataFrame:
    """``scored`` (n_tokens, p_0, ...; settled) with the rate of every row."""
    p = [F.col(f"p_{k}") for k in range(len(DOMAINS))]
    return scored.withColumn("rate", _rate(p, _steps(scored, targets)))


def memberships(p: list, targets: dict[str, float | None]) -> list:
    """Full membership of one domain: an unwanted one that has over half, else the likeliest of the others."""
    wanted = [k for k, d in enumerate(DOMAINS) if targets.get(d) != 0.0]
    unwanted = [k for k in range(len(DOMAINS)) if k not in wanted]
    number = F.lit(wanted[0] if wanted else 0)
    best = p[wanted[0]] if wanted else F.lit(0.0)
    for k in wanted[1:]:
        number, best = F.when(p[k] > best, k).otherwise(number), F.greatest(p[k], best)
    for k in unwanted:
        number = F.when(p[k] > 0.5, k).otherwise(number)
    return [F.when(number == k, 1.0).otherwise(0.0) for k in range(len(DOMAINS))]


def _named(scored: DataFrame, keep: list[str]) -> DataFrame:
    names = {"__n_tokens": "n_tokens"} | {f"__p_{k}": f"p_{k}" for k in range(len(DOMAINS))}
    return scored.select(*keep, *[F.col(a).alias(b) for a, b in names.items()])


def mixed(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float | None] = TARGETS, sample: int = SAMPLE
) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and number of copies of every document.

    Copies are the rate rounded up or down by a hash of the id, so that their mean is the rate.
    """
    scored = settle(_named(posteriors(docs, ["doc_id"], fit(docs, labels, sample)), ["doc_id"]))
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return solve(scored, targets).select(
        "doc_id",
        "n_tokens",
        *[F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)],
        "rate",
        F.floor(F.col("rate") + chance).cast("int").alias("copies"),
    )


def _level(scored: DataFrame, targets: dict[str, float | None], rates: list[float]) -> float:
    """The mean rate of the tokens of wanted domains, every document counted whole for its own."""
    tokens, p = F.col("n_tokens").cast("double"), [F.col(f"p_{k}") for k in range(len(DOMAINS))]
    held = scored.agg(*[F.sum(tokens * x) for x in memberships(p, targets)]).first()
    wanted = [(n or 0.0, r) for d, n, r in zip(DOMAINS, held, rates, strict=True) if targets.get(d) != 0.0]
    total = sum(n for n, _ in wanted)
    if total:
        return sum(n * r for n, r in wanted) / total
    return sum(r for _, r in wanted) / len(wanted) if wanted else 1.0


def wanted_documents(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float | None] = NATURAL, sample: int = SAMPLE
) -> DataFrame:
    """The documents worth at least half as much as wanted text is, once each, with their own columns.

    The rates of the three pure texts are solved on the posteriors of all documents; a document is worth their
    mean under its own posteriors. So text of a domain that is short of its target stays with more that is
    unwanted beside it than text of which there is plenty. A pure text's rate is never negative, and the
    cut is relative to the mean rate of wanted text: how much unwanted text the other documents hold
    moves the rates of all wanted domains, but not by itself the side that a document is on.
    """
    rows = wrapped(docs, "doc_id", "text")
    scored = settle(posteriors(rows, rows.columns, fit(rows, labels, sample)))
    numbers = settle(_named(scored, []))  # few small files, read once a step
    rates = [max(0.0, 1.0 - x) for x in _steps(numbers, targets)]
    worth = sum((F.col(f"__p_{k}") * F.lit(r) for k, r in enumerate(rates)), F.lit(0.0))
    kept = scored.where(worth >= 0.5 * _level(numbers, targets, rates))
    return unwrapped(kept.select(*rows.columns), docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
