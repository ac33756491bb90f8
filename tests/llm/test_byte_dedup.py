import random

import numpy as np
import pytest

from plumbline.llm import suffix_array
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def frame(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


def hold(spark, texts, length, parts=3, **more):
    got = {r["doc_id"]: r for r in suffix_array.repeat_report(frame(spark, texts, parts), length, **more).collect()}
    bodies, masks = brute.repeats(texts, length)
    assert len(got) == len(texts)
    for i, (b, m) in enumerate(zip(bodies, masks, strict=True)):
        spans = sum(bool(x) and not (k and m[k - 1]) for k, x in enumerate(m))
        wanted = (len(b), sum(m), spans, brute.sha(bytes(x for x, g in zip(b, m, strict=True) if not g)))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == wanted


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabet(spark, seed, monkeypatch):
    """Passages that overlap, runs of one letter, hot passages, copies, empty and null texts."""
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choices("abé"[: draw.randint(1, 3)], k=n))
    passages = [word(draw.randint(20, 90)) for _ in range(4)]
    texts = ["".join(draw.choice([word(draw.randint(1, 40)), draw.choice(passages), "x" * 60]) for _ in range(draw.randint(0, 5))) for _ in range(80)]
    if seed:
        monkeypatch.setattr(suffix_array, "HOT", 1)
        monkeypatch.setattr(suffix_array, "HOT_SHARE", 0.5)
    hold(spark, [*texts, None, "", texts[0], passages[0], "short"], 24, short=8, range_rows=300)


def test_many_blocks_and_a_hot_text(spark, monkeypatch):
    """A block in each of 40 partitions; half of the texts are one, the others begin or end with it; a range has few rows."""
    monkeypatch.setattr(suffix_array, "HOT", 3)
    monkeypatch.setattr(suffix_array, "HOT_SHARE", 0.5)
    draw = random.Random(9)
    word = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    one = word(150)
    texts = [one] * 60 + [word(draw.randint(0, 50)) + one[draw.randint(0, 60) : draw.randint(70, 150)] + word(draw.randint(0, 50)) for _ in range(60)]
    hold(spark, texts, 40, parts=40, short=12, range_rows=50)


def test_kinds_are_told_apart_by_bytes():
    """Strings under equal leading bytes and fingerprints count as equal only where their bytes are."""
    bodies = [b"aab", b"aaa", b"aab", b"b", b"aaa", b"aac"]
    part = suffix_array.pa.table({"p1": [0, 0, 0, 1, 0, 0], "p2": [0] * 6, "fp": [7, 7, 7, 7, 7, 8], "body": bodies})
    order, new = suffix_array.sorted_kinds(part)
    assert [bodies[i] for i in order] == [b"aaa", b"aaa", b"aab", b"aab", b"aac", b"b"]
    assert new.tolist() == [True, False, True, False, True, True]


def test_whole_table(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    hold(spark, texts, 200)


def test_multikey_order_is_the_order_of_rows():
    draw = np.random.default_rng(1)
    columns = [draw.integers(0, 4, 500) for _ in range(3)]
    order = suffix_array.multikey_order(columns)
    rows = [tuple(int(c[i]) for c in columns) for i in order]
    assert rows == sorted(rows)


def test_half_characters_go_from_kept_texts(spark):
    texts = ["a" + "é" * 30, "b" + "é" * 30, "c only"]
    got = suffix_array.drop_repeats(frame(spark, texts), 24, 8).collect()
    assert sorted(r["text"] for r in got) == ["a", "b", "c only"]


def test_splitters_from_several_tasks(spark, monkeypatch):
    """Splitters are even whether one task or several take them from the sample; ties and a few suffixes give what they can."""
    draw = random.Random(4)
    texts = ["".join(draw.choices("abcd ", k=draw.randint(20, 90))) for _ in range(80)] + ["e" * 70] * 20
    blocked = suffix_array.blocked(frame(spark, texts), suffix_array.F.col("text"))
    places = suffix_array.written(blocked.selectExpr("0L part", "id", "explode(sequence(0, length(body) - 20)) first", "1 windows", "0 offset", "false hot", "true asked"), "places")
    n, ranges = places.count(), 20
    for tasks in (1_000, 3):
        monkeypatch.setattr(suffix_array, "SORTED_SPLITTERS", tasks)
        found = suffix_array._splitters(blocked, places, 20, -(-n // ranges))
        sizes = [r["count"] for r in suffix_array._suffixes(blocked, places, 20, found).groupBy("range").count().collect()]
        assert ranges - 8 <= len(found) <= ranges and sum(sizes) == n and max(sizes) < 3 * n / ranges
    none = suffix_array._splitters(blocked, places.where("false"), 20, 5)
    assert not len(none)
