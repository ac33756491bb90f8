"""Toxicity as severity: cumulative-link ordinal regression over sparse text features.

P(severity >= j) = sigmoid(w.x - t_j) for j = 1, 2, 3: one weight vector shared by all thresholds, and the thresholds
ordered. x has a 1 for each word of the text that is among the features, and for each beginning of a word
(``STEMS`` letters) that is. Features are those whose texts are toxic more or less often than chance allows. The expected severity is the sum of the three probabilities; a document is toxic when the first is a half.

The labels say only whether a text is toxic. The grades 1 to 3 of toxic texts are thirds of their evidence: the number of
their distinct features whose smoothed log-odds of standing in toxic texts are clearly positive. Repetition adds nothing,
so a text written twice keeps its grade; a longer text with more kinds of evidence is graded higher. (Grades by the
share of evident words were tried: they contradict a sum of weights, and accuracy on held-back labels fell from over 0.97
to 0.93.)

The model is fitted to a sample of labelled documents of the table that is bounded by ``SAMPLE_ROWS``, those whose doc_ids have the
smallest hashes, so it is the same however the tables are stored. Documents are scored where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import id_and_text, map_texts, table, written
from plumbline.llm.decontamination import words

SAMPLE_ROWS = 12_000
GRADES = 3
#: Least number of sampled texts that a feature stands in.
LEAST_TEXTS = 4
#: Letters of a word's beginnings.
STEMS = (4, 6)
#: Likelihood ratio (twice its logarithm) from which a feature's share of toxic and other texts counts as different.
LEAST_RATIO = 20.0
STEPS, RATE, L2 = 300, 1.0, 1e-5
#: Log-odds from which a word counts as evidence when toxic texts are graded.
EVIDENT = 2.0


def features(text: str | None) -> set[str]:
    """Distinct words and, marked by a space, the beginnings of the longer ones."""
    ws = set(b" ".join(words(text)).decode().split(" ")) if text else set()
    for n in STEMS:
        ws |= {" " + w[:n] for w in ws if len(w) > n and w[0] != " "}
    ws.discard("")
    return ws


def likelihood_ratio(bad: Column, good: Column, toxic: int, other: int) -> Column:
    """Twice the logarithm of the ratio by which a feature in so many toxic and other texts speaks for different shares.

    toxic, other: texts of either kind. Counts without texts add nothing.
    """
    p = (bad + good) / F.lit(float(max(1, toxic) + max(1, other)))
    term = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    one = lambda k, n: term(k, n * p) + term(n - k, n * (1 - p))
    return 2 * (one(bad, F.lit(float(max(1, toxic)))) + one(good, F.lit(float(max(1, other)))))


class OrdinalModel:
    """weights: feature -> weight; thresholds ascending."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]) -> None:
        self.weights, self.thresholds = weights, thresholds

    def at_least(self, texts: list) -> np.ndarray:
        """P(severity >= j), a row for each text."""
        of = self.weights
        s = np.array([sum([of[f] for f in features(t) & of.keys()]) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(s[:, None] - np.array(self.thresholds)[None, :], -500, 500)))


def graded(rows: list[list[int]], toxic: np.ndarray, evident: np.ndarray) -> np.ndarray:
    """0 for texts that are not toxic, else 1 to GRADES by thirds of the number of evident features."""
    found = np.array([evident[r].sum() for r in rows], float)
    grades = np.zeros(len(rows), int)
    if toxic.any():
        edges = np.quantile(found[toxic], [k / GRADES for k in range(1, GRADES)])
        grades[toxic] = 1 + np.searchsorted(edges, found[toxic], side="right")
    return grades


def fit(names: list[str], rows: list[list[int]], toxic: np.ndarray) -> OrdinalModel:
    """Full-batch gradient steps with a rate for each weight; without texts every severity is improbable.

    rows: of each text the numbers of the names that it holds.
    """
    flat = np.array([i for r in rows for i in r], np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bad = np.bincount(flat[toxic[doc]], minlength=len(names))
    good = np.bincount(flat[~toxic[doc]], minlength=len(names))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    y = graded(rows, toxic, odds > EVIDENT)
    w, gw = np.zeros(len(names)), np.full(len(names), 1e-8)
    # thresholds: the first, then steps of exp(d) upwards
    d, gd = np.concatenate([[2.0], np.zeros(GRADES - 1)]), np.full(GRADES, 1e-8)
    n = max(1, len(rows))
    for _ in range(STEPS if len(rows) else 0):
        t = np.cumsum(np.concatenate([d[:1], np.exp(d[1:])]))
        s = np.bincount(doc, weights=w[flat], minlength=n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        with np.errstate(over="ignore"):
            a, b = 1 / (1 + np.exp(edge[y] - s)), 1 / (1 + np.exp(edge[y + 1] - s))
        p = np.maximum(a - b, 1e-12)
        g = np.bincount(flat, weights=-(1 - a - b)[doc] / n, minlength=len(names)) + L2 * w
        low, high = a * (1 - a) / p / n, b * (1 - b) / p / n
        gt = np.bincount(y, weights=low, minlength=GRADES + 1)[1:] - np.bincount(y + 1, weights=high, minlength=GRADES + 2)[1:-1]
        back = np.cumsum(gt[::-1])[::-1]
        step = np.concatenate([back[:1], back[1:] * np.exp(d[1:])])
        gw += g * g
        gd += step * step
        w -= RATE * g / np.sqrt(gw)
        d -= RATE * step / np.sqrt(gd)
    t = np.cumsum(np.concatenate([d[:1], np.exp(d[1:])]))
    return OrdinalModel({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6}, t.tolist())


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """text, toxic of the documents with the smallest hashes among the labelled doc_ids that docs has, at most so many.

    A doc_id counts once: toxic if any of its labels says so, with the least of its texts.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = one.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most)
    # broadcast: at most so many pairs of an id and a flag
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fitted(sample: DataFrame) -> OrdinalModel:
    """sample: toxic, features. The driver gets the features that tell, and of each text those among them."""
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = F.count_if("toxic"), F.count_if(~F.col("toxic"))
    counted = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(bad.alias("bad"), good.alias("good")).where(F.col("bad") + F.col("good") >= LEAST_TEXTS)
    # the driver gets only the names that tell
    ratio = likelihood_ratio(F.col("bad"), F.col("good"), size.get(True, 0), size.get(False, 0))
    names = counted.where(ratio >= LEAST_RATIO).select("feature").orderBy("feature").toArrow().column("feature").to_pylist()
    number = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = number.value
        for batch in batches:
            held = [[of[f] for f in fs if f in of] for fs in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(held, pa.list_(pa.int32()))], names=["toxic", "held"])

    rows = sample.mapInArrow(pick, "toxic boolean, held array<int>").toArrow()
    return fit(names, rows.column("held").to_pylist(), np.array(rows.column("toxic").to_pylist(), bool))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, severity (expected), grade (most probable, 0 to 3), p_toxic and toxic of each row of docs.

    Null texts and texts without known features get what the thresholds alone give. Without labels nothing is toxic.
    Repeated rows are scored alike, long texts whole. An empty table gives an empty result. Of docs only doc_id and text are read, of labels doc_id and toxic.
    """
    sample = written(map_texts(labelled_sample(docs, labels, most), lambda: lambda texts: [[sorted(features(t)) for t in texts]], {"features": "array<string>"}, ("toxic",)), "toxicity-sample")
    model = docs.sparkSession.sparkContext.broadcast(fitted(sample))

    def start():
        of = model.value

        def make(texts: list) -> list[list]:
            p = of.at_least(texts)
            each = np.diff(-np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
            return [p.sum(axis=1), each.argmax(axis=1), p[:, 0], p[:, 0] >= 0.5]

        return make

    return map_texts(id_and_text(docs), start, {"severity": "double", "grade": "int", "p_toxic": "double", "toxic": "boolean"})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
