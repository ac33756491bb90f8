import binascii
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import gated_model, lm_scoring, toxicity
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
LARGEST = "/root/testdata/sf0.1"


def test_base_scores_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()
    lists = {r["doc_id"]: [*brute.WORD.findall((r["text"] or "").translate(brute.UPPER)), None] for r in docs}
    held = {d: binascii.crc32(str(d).encode()) % 5 == 1 for d in lists}
    c = Counter(w for d, ws in lists.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm_scoring.op6_lm_scoring(spark, LARGER).collect()}
    assert len(got) == len(docs)
    for d, ws in lists.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    away = [d for d in lists if held[d]]
    words = sum(len(lists[d]) for d in away)
    assert sum(got[d]["score"] - got[d]["base_score"] for d in away) / words > 0.15


@pytest.mark.parametrize("block_bytes", [500_000, 40_000_000])
def test_every_training_document_is_fitted(spark, block_bytes):
    """At any size of block the tokens seen are all training tokens, and head, bands and unseen words are all tokens."""
    docs = lm_scoring.id_and_text(spark.read.parquet(f"{LARGER}/documents.parquet"))
    blocks = lm_scoring.packed(docs.withColumn("held", lm_scoring.held_out(docs["doc_id"])), block_bytes)
    counts = lm_scoring.written(lm_scoring.token_counts(blocks), "test-counts")
    n, v = counts.selectExpr("sum(c)", "count(*)").first()
    words = lm_scoring.vocabulary(counts, 3000)
    assert words.counts.sum() + words.n.sum() == n and len(words.words) == 3000
    assert words.share.sum() == words.n.sum() + 0.5 * (v - 3000 + 1)
    tail = lm_scoring.written(lm_scoring.tail_counts(blocks, counts, words.words.to_pylist()), "test-tail", "round")
    assert lm_scoring.fitted(blocks, tail, words)[1] == n


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    two, nine = ({r["doc_id"]: r for r in lm_scoring.score_documents(docs.repartition(k), block_bytes=200_000).collect()} for k in (2, 9))
    assert two == nine


def test_gradients_are_those_of_the_log_likelihood():
    """Against differences of a plain loop version in double precision."""
    draw = np.random.default_rng(5)
    layout = gated_model.Layout(np.sort(draw.integers(5, 400, 30))[::-1].astype(float), np.array([30.0, 9.0]))
    p = {k: v.astype(float) + draw.normal(0, 0.2, v.shape) for k, v in layout.start().items()}
    x, y = draw.integers(0, layout.start_number, (6, 3)), draw.integers(0, layout.start_number, (6, 3))
    x[0], x[3, 1], y[5, 2] = layout.start_number, layout.start_number, -1

    def loss(p):
        total, h = 0.0, np.zeros((3, gated_model.HIDDEN))
        n = gated_model.HIDDEN
        for t in range(6):
            for lane in range(3):
                if x[t, lane] == layout.start_number:
                    h[lane] = 0
                e, u = p["table"][x[t, lane]], h[lane] @ p["turn"] + p["turn_bias"]
                z, r = (1 / (1 + np.exp(-(e + u)[a : a + n])) for a in (0, n))
                c = np.tanh(e[2 * n :] + r * u[2 * n :])
                h[lane] = z * h[lane] + (1 - z) * c
                w = y[t, lane]
                if w < 0:
                    continue
                s = h[lane] @ p["to_class"] + p["class_bias"]
                k = layout.of[w]
                total -= s[k] - np.log(np.exp(s).sum())
                if k < layout.heads:
                    a, b = layout.edge[k], layout.edge[k + 1]
                    s = p["to_word"][a:b] @ h[lane] + p["word_bias"][a:b]
                    total -= s[w - a] - np.log(np.exp(s).sum())
        return total / 3

    single = {k: v.astype(np.float32) for k, v in p.items()}
    g, words, _ = gated_model.gradients(single, layout, x, y, np.zeros((3, gated_model.HIDDEN), np.float32))
    rows, d = g.pop("table")
    g["table"], g["to_word"], g["word_bias"] = np.zeros_like(p["table"]), np.zeros_like(p["to_word"]), np.zeros_like(p["word_bias"])
    g["table"][rows] = d
    for a, b, weights, biases in words:
        g["to_word"][a:b], g["word_bias"][a:b] = weights, biases
    for name, v in p.items():
        for at in zip(*(draw.integers(0, n, 12) for n in v.shape), strict=True):
            old = v[at]
            v[at] = old + 1e-5
            up = loss(p)
            v[at] = old - 1e-5
            down = loss(p)
            v[at] = old
            assert math.isclose((up - down) / 2e-5, g[name][at], rel_tol=2e-2, abs_tol=2e-4), (name, at)


def test_probabilities_sum_to_one():
    draw = np.random.default_rng(2)
    layout = gated_model.Layout(np.sort(draw.integers(1, 500, 60))[::-1].astype(float), 40.0)
    p = layout.start()
    p, seen = gated_model.train(p, layout, [draw.integers(0, 61, 400) for _ in range(20)])
    assert seen == 8000
    text = draw.integers(0, 61, 70)
    before = gated_model.log_likelihoods(p, layout, [text])[0]
    after = gated_model.log_likelihoods(p, layout, [np.append(text, w) for w in range(61)])
    assert math.isclose(np.exp(after - before).sum(), 1, rel_tol=1e-4)


def test_windows_carry_the_state():
    """Scores of a long text do not depend on the steps between outputs or on the texts beside it."""
    draw = np.random.default_rng(3)
    layout = gated_model.Layout(np.arange(40, 0, -1).astype(float), 10.0)
    p, _ = gated_model.train(layout.start(), layout, [draw.integers(0, 41, 900) for _ in range(10)])
    texts = [draw.integers(0, 41, k) for k in (1, 33, 200, 5)]
    together = gated_model.log_likelihoods(p, layout, texts)
    alone = [gated_model.log_likelihoods(p, layout, [t])[0] for t in texts]
    np.testing.assert_allclose(together, alone, rtol=1e-4)


def test_texts_that_follow_in_a_lane():
    """The last token of a text has its own state, though the next text of the lane starts anew."""
    draw = np.random.default_rng(4)
    layout = gated_model.Layout(np.arange(40, 0, -1).astype(float), 10.0)
    p, _ = gated_model.train(layout.start(), layout, [draw.integers(0, 41, 900) for _ in range(10)])
    texts = [draw.integers(0, 41, k) for k in draw.integers(1, 12, gated_model.SCORED + 300)]
    alone = [gated_model.log_likelihoods(p, layout, [t])[0] for t in texts]
    np.testing.assert_allclose(gated_model.log_likelihoods(p, layout, texts), alone, rtol=1e-4)


def test_logits_beyond_where_exp_overflows():
    """Sums that overflow are made again with bounded logits: gradients and scores stay numbers."""
    layout = gated_model.Layout(np.arange(400, 0, -1).astype(float), 10.0)
    p = {k: v + np.float32(0.3) for k, v in layout.start().items()} | {"class_bias": np.linspace(0, 200, layout.classes, dtype=np.float32), "word_bias": np.linspace(0, 200, layout.n, dtype=np.float32)}
    x = np.random.default_rng(1).integers(0, 400, (6, 3))
    g, words, _ = gated_model.gradients(p, layout, x, x, np.zeros((3, gated_model.HIDDEN), np.float32))
    rows, d = g.pop("table")
    assert all(np.isfinite(v).all() for v in [d, *g.values(), *words[0][2:]])
    assert np.isfinite(gated_model.log_likelihoods(p, layout, [*x])).all()


def test_tokens_are_words_and_one_end():
    """Against the contract's expression, for every ASCII character and others that count as white space elsewhere."""
    texts = ["", " ", "A b\tB  a ", "\n\n", *[f"X{chr(c)}y{chr(c)}{chr(c)}É" for c in [*range(128), 0x85, 0xA0, 0x2003, 0x3000]]]
    tokens, line, size = lm_scoring._numbered(texts)
    said, at = tokens.to_pylist(), 0
    for text, n in zip(texts, size.tolist(), strict=True):
        wanted = [w.encode() for w in brute.WORD.findall(text.translate(brute.UPPER))] + [lm_scoring.END]
        assert [said[i] for i in line[at : at + n]] == wanted, repr(text)
        at += n
    assert at == len(line) and len(set(said)) == len(said)


def test_training_learns_an_order():
    layout = gated_model.Layout(np.ones(10) * 100, 1.0)
    cycle = np.tile(np.arange(10), 60)
    p, _ = gated_model.train(layout.start(), layout, [cycle] * 40)
    assert gated_model.log_likelihoods(p, layout, [cycle])[0] / len(cycle) > math.log(0.5)


def test_toxicity_on_labels_left_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("doc_id % 4 <> 0")
    got = toxicity.toxicity(docs, fit).join(labels.where("doc_id % 4 = 0").select("doc_id", "toxic").withColumnRenamed("toxic", "label"), "doc_id").collect()
    right = sum(r["toxic"] == (r["label"] == 1) for r in got)
    bad = [r for r in got if r["label"] == 1]
    assert len(got) > 200 and right / len(got) > 0.97
    assert sum(r["toxic"] for r in bad) / len(bad) > 0.85
    for r in got:
        assert 0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 and r["toxic"] == (r["p_toxic"] >= 0.5)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, ""), (1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 4 and not any(r["toxic"] for r in got)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_telling_words_at_any_share_of_toxic_labels(spark, share):
    """A word of half of the toxic texts and one of half of the others; most labels are of texts that docs lacks."""
    draw = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(600):
        bad = i < 600 * share
        own = ["vile"] * bool(bad and i % 2) + ["kind"] * bool(not bad and i % 2)
        rows.append((i, " ".join([*(f"w{j}" for j in draw.integers(0, 30, 12)), *own])))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(i, 0) for i in range(10_000, 12_000)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, 600)
    assert sample.count() == 600
    held = toxicity.map_texts(sample, lambda: lambda texts: [[sorted(toxicity.features(t)) for t in texts]], {"features": "array<string>"}, ("toxic",))
    weights = toxicity.fitted(held).weights
    assert weights["vile"] > 0 > weights["kind"]


def test_a_doubled_text_keeps_its_grade():
    model = toxicity.OrdinalModel({"vile": 2.0, "vilest": 1.5, " vile": 0.5, "calm": -1.0}, [1.0, 2.5, 4.0])
    texts = ["vile vilest and calm", "calm", "vile"]
    np.testing.assert_array_equal(model.at_least(texts), model.at_least([f"{t} {t}" for t in texts]))
    evident = np.array([True, True, False])
    assert toxicity.graded([[0, 1], [0], [2], [0, 2]], np.array([True, True, True, False]), evident).tolist() == [3, 2, 1, 0]


def test_fit_lowers_the_plain_loss_and_scores_are_plain_sums():
    """The likelihood, written out text by text, is better than that of any small step away; scores are sums of weights."""
    draw = np.random.default_rng(8)
    names = [f"f{i}" for i in range(6)]
    rows = [sorted(set(draw.integers(0, 6, 3).tolist())) for _ in range(300)]
    toxic = np.array([draw.random() < (0.7 if 0 in r else 0.15) for r in rows])
    model = toxicity.fit(names, rows, toxic)
    bad, good = (np.array([sum(i in r for r, t in zip(rows, toxic, strict=True) if t == side) for i in range(6)]) for side in (True, False))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    y = toxicity.graded(rows, toxic, odds > toxicity.EVIDENT)

    def loss(w, t):
        total = 0.0
        for r, g in zip(rows, y, strict=True):
            s = sum(w[i] for i in r)
            at = [1.0, *(1 / (1 + math.exp(x - s)) for x in t), 0.0]
            total -= math.log(at[g] - at[g + 1])
        return total / 300 + toxicity.L2 / 2 * sum(x * x for x in w)

    w, t = [model.weights.get(n, 0.0) for n in names], model.thresholds
    assert t == sorted(t)
    for i in range(6):
        for step in (-0.3, 0.3):
            assert loss([x + step * (i == j) for j, x in enumerate(w)], t) > loss(w, t) - 5e-4
    texts = ["f0 f1 f1", "", None, "f5 other"]
    plain = [sum(model.weights.get(f, 0.0) for f in set((x or "").split())) for x in texts]
    np.testing.assert_allclose(model.at_least(texts), [[1 / (1 + math.exp(x - s)) for x in t] for s in plain])


def test_a_common_word_with_a_small_lift_tells(spark):
    """2000 of 12,000 texts, of which 20% are toxic where 11% of all are."""
    found = spark.range(1).select(toxicity.likelihood_ratio(F.lit(400), F.lit(1600), 1320, 10_680).alias("r"), toxicity.likelihood_ratio(F.lit(220), F.lit(1780), 1320, 10_680).alias("even"), toxicity.likelihood_ratio(F.lit(9), F.lit(0), 9, 0).alias("one")).first()
    k, n = np.array([400.0, 1600.0]), np.array([1320.0, 10_680.0])
    p = k.sum() / n.sum()
    assert math.isclose(found["r"], 2 * (k * np.log(k / n / p) + (n - k) * np.log((n - k) / n / (1 - p))).sum())
    assert found["r"] > 100 > toxicity.LEAST_RATIO > abs(found["even"])
    assert math.isfinite(found["one"])
