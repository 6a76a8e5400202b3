"""Toxic passages by maximum-scoring segments.

Every word has a log-odds score, toxic against clean, with a Dirichlet prior of the words' overall frequencies. Of a
word's odds the bound nearest to zero counts that holds for all words of the vocabulary at once, so a word with little
behind it scores next to nothing; a constant drift makes every word of ordinary text cost a little. One linear scan
finds all maximal-scoring segments of a text, and extreme-value statistics say how many segments of that score clean
text of that length would hold by chance. The significant ones are the text's toxic passages; their evidence, summed,
is turned into a probability.

A text counts for a word once, and texts count only once for each distinct context (the words beside the word where it
first comes), so neither repetition in a text nor copies of a labelled text count again. A text is its words only: language, source and key are no inputs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the classifier is fitted on at most (those of the smallest key hash). The model holds words of these only.
MAX_LABELLED = 20_000
#: Weight of the Dirichlet prior in words; what every word costs; surprise from which on a passage counts (one in twenty by chance).
PRIOR_WORDS, DRIFT, LEAST_SURPRISE = 500.0, -0.5, math.log(20)
#: Evidence beyond which the logistic fit tells no more degrees apart: the weight is that of deciding, not of long lists.
ENOUGH = 8.0
#: How often any word of the vocabulary at all may have true odds nearer to zero than its bound.
FALSE_WORDS = 0.05

WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """The words of a text, lowered one by one: the n-th is the n-th match of WORD in the text itself."""
    return [w.lower() for w in WORD.findall(text)]


@dataclass
class Model:
    """Bounds of the words' log-odds (0 for all others); ``decay`` and ``rate`` of the expected segments ``rate * words * exp(-decay * score)``; logistic weights."""

    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    rate: float = 1e-6
    bias: float = -3.0
    weight: float = 1.0

    def __post_init__(self):
        self.toxic = {w for w, s in self.scores.items() if s + DRIFT > 0}

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and all maximal segments as (first word, word after, score)."""
        words = words_of(text)
        return len(words), [] if self.toxic.isdisjoint(words) else maximal_segments([self.scores.get(w, 0.0) + DRIFT for w in words])

    def surprise(self, words: int, score: float) -> float:
        """Minus the logarithm of how many segments of this score clean text of this length holds by chance."""
        return self.decay * score - math.log(self.rate * max(words, 1))

    def evidence(self, words: int, segments: list[tuple[int, int, float]]) -> float:
        return sum(x for _, _, s in segments if (x := self.surprise(words, s)) > LEAST_SURPRISE)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, self.bias + self.weight * evidence))))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring contiguous segments, left to right, in linear time."""
    # Kept segments: first, after, sum before, sum through, and the nearest kept one on the left that began lower.
    kept: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, low, high = i, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, i + 1, low, high, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def remainder(doc_id: str = "doc_id"):
    """What divides labelled rows: 0 is held out, 1 to 3 give the word counts, 4 the calibration."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 4096):
        seen = set()
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words = words_of(text or "")
            first = {w: i for i, w in reversed([*enumerate(words)])}
            for w, i in first.items():
                around = "".join(words[max(0, i - 1) : i]) + "\0" + "".join(words[i + 1 : i + 2])
                seen.add((w, xxhash.xxh3_64_intdigest(around) - 2**63, toxic))
        cols = list(zip(*seen, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32()), strict=True)], names=["word", "context", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled rows outside the held-out fifth. Null labels and keys don't count; of several labels of a key the greatest does.

    With no toxic or no clean rows to learn from, no word has a score and every text gets the same low probability.
    """
    common.ship_package(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder() != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # At most max_labelled rows of two numbers.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    counted = rows.filter(remainder() < 4).select("text", "toxic").mapInArrow(_contexts, "word string, context long, toxic int").distinct()
    by_word = counted.groupBy("word").agg(F.sum((F.col("toxic") > 0).cast("long")).alias("t"), F.sum((F.col("toxic") <= 0).cast("long")).alias("c"))
    by_word = common.written(by_word, "words")
    total = by_word.agg(F.sum("t"), F.sum("c"), F.count(F.lit(1))).first()
    n_t, n_c, vocabulary = (int(x or 0) for x in total)
    if not n_t or not n_c:
        common.discard(by_word)
        return Model()
    # How surprising the split of a word's contexts is against the overall split, as a likelihood ratio; its root says in
    # how many standard errors the odds are. The bound lies as many of them nearer to zero as all words together ask for.
    n, part = F.col("t") + F.col("c"), n_t / (n_t + n_c)
    term = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(F.lit(0.0))
    errors = F.sqrt(F.greatest(F.lit(0.0), 2 * (term(F.col("t"), part) + term(F.col("c"), 1 - part))))
    prior = n * (PRIOR_WORDS / (n_t + n_c))
    p_t, p_c = (F.col("t") + prior) / (n_t + PRIOR_WORDS), (F.col("c") + prior) / (n_c + PRIOR_WORDS)
    odds = F.log(p_t / (1 - p_t)) - F.log(p_c / (1 - p_c))
    least = NormalDist().inv_cdf(1 - FALSE_WORDS / (2 * vocabulary))
    bound = by_word.withColumn("errors", errors).filter(F.col("errors") > least).select("word", (odds * (1 - least / F.col("errors"))).alias("score"), p_c.alias("share"))
    # Words of at most max_labelled rows.
    scores, clean_share = {}, {}
    for r in bound.collect():
        scores[r["word"]], clean_share[r["word"]] = r["score"], r["share"]
    common.discard(by_word)
    return _calibrated(Model(scores), rows.filter(remainder() == 4), clean_share)


def _decay(scores: dict[str, float], share: dict[str, float]) -> float:
    """The positive root of E[exp(decay * score)] = 1 for words of clean text."""
    s, p = np.array(list(scores.values())) + DRIFT, np.array([share[w] for w in scores])
    rest = max(0.0, 1 - p.sum())
    moment = lambda x: float(p @ np.exp(x * s)) + rest * math.exp(x * DRIFT) - 1
    low, high = 1e-3, 1e-3
    while moment(high) < 0 and high < 8:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    return high


def _calibrated(model: Model, rows: DataFrame, share: dict[str, float]) -> Model:
    if not model.toxic:
        return model

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                n, found = model.segments(text or "")
                out.append((n, [s for _, _, s in found]))
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.float64()))], names=["toxic", "n", "segments"])

    # At most a fifth of max_labelled rows of a few numbers each.
    seen = rows.select("toxic", "text").mapInArrow(run, "toxic int, n long, segments array<double>").collect()
    least = min(model.scores[w] for w in model.toxic) + DRIFT
    over = sum(s >= least for r in seen if r["toxic"] <= 0 for s in r["segments"])
    words = sum(r["n"] for r in seen if r["toxic"] <= 0)
    decay = _decay(model.scores, share)
    model = Model(model.scores, decay, (over + 0.5) / max(words, 1) * math.exp(decay * least))
    x = np.array([model.evidence(r["n"], [(0, 0, s) for s in r["segments"]]) for r in seen])
    y = np.array([r["toxic"] > 0 for r in seen], dtype=float)
    if 0 < y.sum() < len(y):
        model.bias, model.weight = _logistic(np.minimum(x, ENOUGH), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Ridge logistic regression on one feature, by Newton's method."""
    features, w = np.stack([np.ones_like(x), x], axis=1), np.array([0.0, 0.1])
    ridge = np.array([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + np.diag(ridge), features.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, passages``: passages are the significant segments with their expected number by chance.

    ``passages array<struct<start,end,score,expected>>``, offsets in code points. Null and empty texts have none and
    the base probability. Repeated rows and null ids each give a row; other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # words of at most MAX_LABELLED rows
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches):
        model = shared.value
        for batch in common.slices(batches):
            scores, passages = [], []
            for text in batch["text"].to_pylist():
                text = text or ""
                n, found = model.segments(text)
                scores.append(model.probability(model.evidence(n, found)))
                found = [(a, b, s, math.exp(-x)) for a, b, s in found if (x := model.surprise(n, s)) > LEAST_SURPRISE]
                if found:
                    at = [m.span() for m in WORD.finditer(text)]
                    found = [{"start": at[a][0], "end": at[b - 1][1], "score": s, "expected": e} for a, b, s, e in found]
                passages.append(found)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, pa.list_(passage))], names=["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<start:long,end:long,score:double,expected:double>>")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose text the model predicts to be toxic; rows with null texts stay, unchanged."""
    spark = docs.sparkSession
    common.ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # words of at most MAX_LABELLED rows
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in common.slices(batches):
            keep = [model.probability(model.evidence(*model.segments(t or ""))) < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
