import math
import random
import re
import zlib
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from revquarry.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def brute_segments(scores):
    """Maximal segments by their definition: the best one, then those of what is left on either side of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return brute_segments(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_maximal_segments_are_those_of_the_definition():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1.5, -1, 1.25, 2, 3.5]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in T.maximal_segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_long_inputs_are_linear():
    assert len(T.maximal_segments([1.0, -2.0] * 200_000)) == 200_000
    assert T.maximal_segments([1.0] * 200_000) == [(0, 200_000, 200_000.0)]


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    return docs, labels, T.fit(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    seen = T.score(docs, model).join(labels, "doc_id").filter(T.remainder() == 0)
    n = {(r.predicted, r.toxic): r["count"] for r in seen.groupBy("predicted", "toxic").count().collect()}
    # A good fifth of the toxic labels are on texts without any toxic word.
    assert n.get((1, 0), 0) <= 0.005 * n[0, 0]
    assert n[1, 1] >= 0.8 * (n[1, 1] + n[0, 1])


def test_passages_and_edges(spark, fitted):
    _, _, model = fitted
    calm = "the and of in that with " * 300
    bad = "you pathetic idiot, worthless scum"
    rows = [(1, calm + bad + " " + calm, "x"), (2, calm, "x"), (3, "", "x"), (4, None, "x"), (5, bad, "x"), (5, bad, "x"), (None, bad, "x"), (6, calm * 30 + bad + " " + calm * 30 + bad, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = T.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].predicted for k in (1, 2, 3, 4, 5, None, 6)] == [1, 0, 0, 0, 1, 1, 1]
    assert [len(by[k].passages) for k in (1, 2, 3, 4, 5, 6)] == [1, 0, 0, 0, 1, 2]
    p = by[1].passages[0]
    assert rows[0][1][p.start : p.end] == "pathetic idiot, worthless scum" and p.expected < 0.05
    assert by[5].score > by[2].score == by[3].score
    kept = T.reject(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_nothing_to_learn_from(spark, fitted):
    docs, labels, _ = fitted
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = T.fit(docs.limit(50), some)
        assert not model.scores
        assert {r.predicted for r in T.score(docs.limit(50), model).collect()} == {0}
    assert T.score(docs.limit(0), T.Model()).count() == 0


def test_only_words_count(fitted):
    docs, labels, model = fitted
    a = docs.limit(200)
    b = a.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("other")).withColumn("doc_id", F.col("doc_id") + 7)
    x = {r.doc_id: r.score for r in T.score(a, model).collect()}
    assert all(x[r.doc_id - 7] == r.score for r in T.score(b, model).collect())


def test_passages_lie_where_their_words_are(spark, fitted):
    """Lowering a letter may make two characters, one of them no word's: offsets are those of the text itself."""
    _, _, model = fitted
    text = "\u0130\u0130 \u0130x and of " * 30 + "you pathetic idiot, worthless scum" + " in the and" * 30
    docs = spark.createDataFrame([(1, text), (2, "the and of " * 100_000 + text)], "doc_id long, text string")
    for r, whole in zip(T.score(docs, model).orderBy("doc_id").collect(), (text, "the and of " * 100_000 + text), strict=True):
        assert [whole[p.start : p.end] for p in r.passages] == ["pathetic idiot, worthless scum"]


def brute_model(rows, least_of=T.FALSE_WORDS):
    """Word counts, bounds and extreme-value statistics by plain loops over (remainder, text, toxic)."""
    contexts, held = set(), []
    for rest, text, toxic in rows:
        words = [m.lower() for m in re.findall(r"\w+", text)]
        if rest == 4:
            held.append((words, toxic))
        if rest in (1, 2, 3):
            for w in set(words):
                i = words.index(w)
                contexts.add((w, tuple(words[max(0, i - 1) : i]), tuple(words[i + 1 : i + 2]), toxic))
    counts = {}
    for w, _, _, toxic in contexts:
        counts.setdefault(w, [0, 0])[toxic] += 1
    n_c, n_t = (sum(c[k] for c in counts.values()) for k in (0, 1))
    least = NormalDist().inv_cdf(1 - least_of / 2 / len(counts))
    scores, share = {}, {}
    for w, (c, t) in counts.items():
        q = n_t / (n_t + n_c)
        ratio = sum(k * math.log(k / ((t + c) * p)) for k, p in ((t, q), (c, 1 - q)) if k)
        errors = math.sqrt(max(0, 2 * ratio))
        prior = T.PRIOR_WORDS * (t + c) / (n_t + n_c)
        p, r = (t + prior) / (n_t + T.PRIOR_WORDS), (c + prior) / (n_c + T.PRIOR_WORDS)
        if errors > least:
            scores[w], share[w] = (math.log(p / (1 - p)) - math.log(r / (1 - r))) * (1 - least / errors), r
    return scores, share, held


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(31)
    calm, foul = [f"w{i}" for i in range(60)], ["grub", "scab", "louse"]
    rows = []
    for i in range(900):
        words = rng.choices(calm, k=rng.randint(5, 40))
        toxic = int(rng.random() < 0.2)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(foul), rng.choice(calm), rng.choice(foul)]
        rows.append((i, " ".join(words), toxic))
    rest = {i: zlib.crc32(str(i).encode()) % 5 for i, _, _ in rows}
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    scores, share, held = brute_model([(rest[i], text, toxic) for i, text, toxic in rows])
    assert set(scores) == set(model.scores) >= set(foul) and all(abs(model.scores[w] - x) < 1e-9 for w, x in scores.items())

    def segments(words):
        return [s for _, _, s in brute_segments([scores.get(w, 0) + T.DRIFT for w in words])]

    # The decay solves E[exp(decay * score)] = 1 over clean words; the rate is that of clean text's segments.
    moment = sum(share[w] * math.exp(model.decay * (s + T.DRIFT)) for w, s in scores.items()) + (1 - sum(share.values())) * math.exp(model.decay * T.DRIFT)
    assert abs(moment - 1) < 1e-6
    least = min(s for s in scores.values() if s + T.DRIFT > 0) + T.DRIFT
    clean = [w for w, toxic in held if not toxic]
    rate = (sum(s >= least for w in clean for s in segments(w)) + 0.5) / sum(map(len, clean)) * math.exp(model.decay * least)
    assert abs(model.rate / rate - 1) < 1e-9

    def evidence(words):
        surprise = [model.decay * s - math.log(rate * max(1, len(words))) for s in segments(words)]
        return sum(x for x in surprise if x > T.LEAST_SURPRISE)

    # The weights are where the penalised likelihood of the calibration rows is flat.
    x, y = [min(evidence(w), T.ENOUGH) for w, _ in held], [t for _, t in held]
    p = [1 / (1 + math.exp(-(model.bias + model.weight * e))) for e in x]
    assert abs(sum(b - a for a, b in zip(p, y, strict=True)) - 1e-3 * model.bias) < 1e-6
    assert abs(sum((b - a) * e for a, b, e in zip(p, y, x, strict=True)) - 1e-2 * model.weight) < 1e-6
    got = {r.doc_id: (r.score, r.predicted) for r in T.score(docs, model).collect()}
    for i, text, _ in rows:
        want = 1 / (1 + math.exp(-(model.bias + model.weight * evidence(text.split()))))
        assert abs(got[i][0] - want) < 1e-9 and got[i][1] == int(got[i][0] >= 0.5)
