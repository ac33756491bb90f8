import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import periodic_runs
from plumbline.llm.blocks import numbering
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def runs(words, least=12):
    """Every maximal stretch of every period, but for those with a smaller period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(least, 2 * q) and not any(own[d:] == own[: len(own) - d] for d in range(1, q)):
                out.append((i, len(own), q))
            i = j
    return sorted(out)


def changed(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected(doc_id, text):
    words = changed(doc_id, brute.WORD.findall(text or ""))
    found = runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, brute.sha("".join(f"{a},{b},{c}\n" for a, b, c in sorted(found, key=lambda r: (r[0], r[2])))), brute.sha(kept(words, found)))


def drawn(draw):
    kind = draw.random()
    if kind < 0.3:
        return draw.choices("ab", k=draw.randint(0, 60))
    if kind < 0.6:
        unit = draw.choices("abc", k=draw.randint(1, 9))
        return (unit * 20)[: draw.randint(0, 70)] + draw.choices("abc", k=draw.randint(0, 20)) + unit * 9
    if kind < 0.7:
        a, b = ["a"], ["a", "b"]
        while len(b) < 80:
            a, b = b, b + a
        return b
    return draw.choices("abcdefgh", k=draw.randint(0, 80))


def test_runs_against_brute_force():
    draw = random.Random(3)
    for _ in range(300):
        docs, number = [drawn(draw) for _ in range(draw.randint(1, 5))], numbering()
        numbers = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in docs]
        assert periodic_runs._runs_of(np.concatenate(numbers), [len(w) for w in docs], 12) == [runs(w) for w in docs]


def test_digests_against_brute_force(spark):
    """Invented texts in small batches, and the documents; texts of one word, of nothing, and null."""
    draw = random.Random(5)
    rows = [(i, " ".join(drawn(draw))) for i in range(400)] + [(900, None), (901, ""), (902, " \t\n"), (903, "ha " * 3000), (904, "a b " * 12 + "a b"), (903, "ha " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, periodic_runs.run_digests(docs, batch_words=300).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)


def test_whole_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = periodic_runs.op12_periodic_runs(spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in docs), key=repr)


def test_runs_and_texts_of_the_operator_itself(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y"), (None, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "n_words", "collapsed")})
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 15, 3)] and got[1]["collapsed"] == "x a b c y" and got[1]["n_words"] == 17
    assert got[None]["runs"] == [] and got[None]["collapsed"] == ""
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
