"""Quality classifier: Bradley-Terry ranking of documents by pairs.

A document's features are shares and logarithms read off its whole text. From
labelled rows, pairs (better, worse) are formed, and a weight vector is learned
by logistic loss on the difference of their features: the model says how likely
one document beats the other. The threshold is a quantile of the scores of the
labelled rows, at the share of worse ones, so that as many pass as are better.

All labelled rows that aren't held out are fitted. Up to ``BLOCK_ROWS`` of them
are fitted on the driver; more are dealt by a hash of the id to blocks of about
that many, where each row enters at least one pair. Executors add up moments,
gradients and curvatures of a block, and the driver sums one row for each
block. The threshold is found among the scores of all of them by counting.

Nulls and edges: a null text is the empty text and is scored. Labels without a
doc_id or quality are left out; of repeated labels the lowest counts. Without
labels of both kinds all scores are 0.5. Rows that share a ``doc_id`` are each
scored by their own text. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import common

#: Labelled rows that are paired among themselves, the least pairs for each row of a block's rarer kind, and how many of these a block has at least, if there are.
BLOCK_ROWS, PAIRS, LEAST = 20_000, 8, 64

FEATURES = (
    "log_words", "upper_words", "symbols", "pipes", "bangs", "digits", "distinct_words", "repeats", "distinct_lines", "word_length",
    "long_words", "line_length", "periods", "commas", "marked_words", "packed", "no_words",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ",.!?'\"-:;()|"]] = True


#: Bytes that are compressed at a time.
BLOCK = 16384


def packed(raw: bytes) -> float:
    """The share that compression leaves of a text: all its blocks, weighed by their size."""
    return sum(len(zlib.compress(raw[at : at + BLOCK], 1)) for at in range(0, len(raw), BLOCK)) / len(raw)


def features(text: str | None) -> list[float]:
    """A text's features; those of the empty text are 0 but the last."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x]
    share = lambda k, of: float(k) / of
    tails = "".join(w[-1] for w in words)
    return [
        np.log1p(n) / 5,
        share(sum(w.isupper() for w in words if len(w) > 1), n),
        min(1.0, 5 * share(count[_SYMBOL].sum(), size)),
        min(1.0, 10 * share(count[ord("|")], size)),
        min(1.0, 10 * share(count[ord("!")], size)),
        share(count[48:58].sum(), size),
        share(len(set(words)), n) ** 0.5,
        share(sum(map(str.__eq__, words, words[1:])), n),
        share(len(set(lines)), len(lines)),
        min(2.0, share(size, n) / 10),
        share(sum(len(w) > 20 for w in words), n),
        np.log1p(share(n, len(lines))) / 5,
        min(1.0, 5 * share(count[ord(".")], n)),
        min(1.0, 5 * share(count[ord(",")], n)),
        share(n - sum(map(str.isalnum, tails)) - count[ord(",")] - count[ord(".")], n),
        packed(raw),
        0.0,
    ]


@dataclass(frozen=True)
class Model:
    """Standardised features times weights, less the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.abs(z)]) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -50, 50)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, np.abs(z)])


def _differences(z: np.ndarray, better: np.ndarray, pairs: int, seed: int = 0) -> np.ndarray:
    """Better less worse: each row is in a pair, each of the rarer kind in ``pairs`` at least."""
    good, bad = z[better], z[~better]
    few, many = (good, bad) if len(good) < len(bad) else (bad, good)
    if not len(few):
        return np.zeros((0, z.shape[1]))
    rng = np.random.default_rng(seed)
    n = max(pairs * len(few), len(many))
    turns = np.concatenate([rng.permutation(len(many)) for _ in range(-(-n // len(many)))])[:n]
    return (many[turns] - few[np.arange(n) % len(few)]) * (1 if many is good else -1)


def _slopes(diff: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(diff @ w, -50, 50)))
    return diff.T @ (p - 1), (diff * (p * (1 - p))[:, None]).T @ diff


def _newton(slopes, ridge: float, rounds: int) -> np.ndarray:
    """Weights by Newton steps; ``slopes`` gives number, gradient and curvature of all pairs."""
    d = 2 * len(FEATURES)
    w = np.zeros(d)
    for _ in range(rounds):
        n, gradient, curvature = slopes(w)
        step = np.linalg.solve(curvature / n + ridge * np.eye(d), gradient / n + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _places(n: int, worse: int) -> list[float]:
    """The two ranks, with fractions, whose scores' mean is the threshold."""
    return [q * (n - 1) for q in (max(0.0, (worse - 0.5) / n), min(1.0, (worse + 0.5) / n))]


def fit(x: np.ndarray, better: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-2, rounds: int = 25) -> Model:
    """Learn from rows ``x`` and marks ``better`` by Newton steps on pair differences."""
    if not len(x) or better.all() or not better.any():
        return _nothing()
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = _standard(x, mean, scale)
    diff = _differences(z, better, pairs)
    w = _newton(lambda w: (len(diff), *_slopes(diff, w)), ridge, rounds)
    scores = np.sort(z @ w)
    return Model(mean, scale, w, float(np.mean(np.interp(_places(len(x), int((~better).sum())), np.arange(len(x)), scores))))


def _nothing() -> Model:
    return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(2 * len(FEATURES)), 0.0)


def _fit_blocks(rows: DataFrame, n: int, better: int, block_rows: int, pairs: int = PAIRS, ridge: float = 1e-2, rounds: int = 25) -> Model:
    """``fit`` for the written ``(doc_id, quality, x)`` rows, ``better`` of ``n`` with quality 1, in blocks."""
    blocks = -(-n // block_rows)
    d = len(FEATURES)
    spark = rows.sparkSession
    # A kind so rare that blocks would lack it goes to several blocks, or to all; extra copies only make pairs.
    spread = {q: min(blocks, max(1, -(-LEAST * blocks // k))) for q, k in ((True, better), (False, n - better))}
    copies = F.when(F.col("quality") == 1, spread[True]).otherwise(spread[False])
    dealt = rows.select("doc_id", (F.col("quality") == 1).alias("better"), "x", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id") + F.col("copy"), F.lit(blocks)))

    def pack(key, table):
        table = table.sort_values("doc_id")
        return pd.DataFrame({"block": [key[0]], "x": [np.array(table.x.tolist(), float).tobytes()], "better": [table.better.to_numpy(bool).tobytes()], "first": [(table["copy"] == 0).to_numpy(bool).tobytes()]})

    packed = common.write_table(dealt.groupBy("block").applyInPandas(pack, "block long, x binary, better binary, first binary"), "learned")

    def each(f, schema):
        """``f(x, better, first, block)`` of every block, in the order of the blocks where collected."""

        def work(batches):
            for batch in batches:
                for r in batch.itertuples():
                    got = f(np.frombuffer(r.x).reshape(-1, d), np.frombuffer(r.better, bool), np.frombuffer(r.first, bool), r.block)
                    yield pd.DataFrame({"block": r.block, "v": got})

        return packed.mapInPandas(work, schema)

    def summed(f):
        got = each(lambda *a: [np.concatenate([np.ravel(v) for v in f(*a)]).tolist()], "block long, v array<double>").collect()
        return np.sum([r.v for r in sorted(got, key=lambda r: r.block)], axis=0)

    # One block at a time goes to Python.
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        mean = summed(lambda x, good, first, _: [x[first].sum(0)]) / n
        scale = np.sqrt(summed(lambda x, good, first, _: [((x[first] - mean) ** 2).sum(0)]) / n) + 1e-3

        def slopes(w):
            def one(x, good, first, block):
                diff = _differences(_standard(x, mean, scale), good, pairs, block)
                return len(diff), *_slopes(diff, w)

            s = summed(one)
            return s[0], s[1 : 1 + 2 * d], s[1 + 2 * d :].reshape(2 * d, 2 * d)

        w = _newton(slopes, ridge, rounds)
        scores = common.write_table(each(lambda x, good, first, _: _standard(x[first], mean, scale) @ w, "block long, v double").select("v"), "scores")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    places = _places(n, n - better)
    ranks = sorted({int(r) for p in places for r in (np.floor(p), np.ceil(p))})
    found = _order_statistics(scores, ranks)
    return Model(mean, scale, w, float(np.mean(np.interp(places, ranks, [found[r] for r in ranks]))))


def _order_statistics(scores: DataFrame, ranks: list[int], most: int = 50_000, bins: int = 4096) -> dict[int, float]:
    """The values ``v`` of these neighbouring ranks, from 0: counted in ever narrower ranges, until the distinct values there are few."""
    below, found = 0, scores.groupBy("v").agg(F.count("*").alias("n"))
    while True:
        at = found.agg(F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        step = (at.hi - at.lo) / bins
        if at.rows <= most or not step:
            break
        place = F.least(F.floor((F.col("v") - at.lo) / step), F.lit(bins - 1))
        count = dict(found.groupBy(place.alias("bin")).agg(F.sum("n").alias("n")).collect())
        keys = sorted(count)
        ends = below + np.cumsum([count[k] for k in keys])
        i, j = (int(np.searchsorted(ends, r, "right")) for r in (ranks[0], ranks[-1]))
        if len(keys) == j - i + 1:
            break
        below += sum(count[k] for k in keys[:i])
        found = found.filter(place.between(keys[i], keys[j]))
    rows = sorted(found.collect())
    ends = below + np.cumsum([r.n for r in rows])
    return {r: rows[int(np.searchsorted(ends, r, "right"))].v for r in ranks}


def learned_rows(labels: DataFrame, max_labelled: int | None = None) -> DataFrame:
    """Labelled rows to learn from: all that aren't held out; a caller may ask for so many at most, by hash."""
    rows = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return rows if max_labelled is None else rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def held_out():
    """Whether the crc32 of the id as text leaves 1 when divided by 3; null without an id: false."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def described(documents: DataFrame) -> DataFrame:
    """The written ``doc_id``, ``held_out`` and features ``x`` of every document."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return common.write_table(documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), of(common.text_or_empty()).alias("x")), "features")


def train(rows: DataFrame, labels: DataFrame, max_labelled: int | None = None, block_rows: int = BLOCK_ROWS) -> Model:
    """Fit on all labelled rows of ``described``; texts are neither sent nor shuffled."""
    found = rows.join(learned_rows(labels, max_labelled), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "x")
    found = common.write_table(found, "labelled")
    n, better = found.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    if n > block_rows and 0 < better < n:
        return _fit_blocks(found, n, better, block_rows)
    if not 0 < better < n:
        return _nothing()
    some = sorted((r.doc_id, r.quality, r.x) for r in found.collect())
    return fit(np.array([f for _, _, f in some], dtype=float), np.array([q == 1 for _, q, _ in some], dtype=bool))


def score_column(model: Model, text="text"):
    """The score of a text column, from 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array([features(t) for t in texts])))

    return score(F.coalesce(F.col(text).cast("string"), F.lit("")))


def classify(documents: DataFrame, labels: DataFrame, max_labelled: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    rows = described(documents)
    model = train(rows, labels, max_labelled, block_rows)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), dtype=float)) if len(x) else [], dtype=float)

    scored = rows.select("doc_id", "held_out", score("x").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_quality(documents: DataFrame, labels: DataFrame, max_labelled: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return documents.filter(score_column(train(described(documents), labels, max_labelled, block_rows)) >= 0.5)


def op3_quality_bt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
