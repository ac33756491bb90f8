import random

from plumbline.llm import simhash
from plumbline.llm.components import components
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute.fingerprint(r["text"]) for r in docs]
    wanted = dict(zip([r["doc_id"] for r in docs], zip([f"{f:016x}" for f in fps], brute.components([r["doc_id"] for r in docs], fps), strict=True), strict=True))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(spark, SMALL).collect()}
    assert got == wanted


def test_links_over_many_shards(spark, monkeypatch):
    """Random fingerprints, many with equal leading bits, and neighbours at 1 to 4 bits."""
    draw = random.Random(5)
    fps = set()
    for _ in range(150):
        f = draw.getrandbits(64) if draw.random() < 0.5 else draw.getrandbits(12)
        for _ in range(4):
            fps.add(f)
            for _ in range(draw.randint(1, 4)):
                f ^= 1 << draw.randrange(64)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    monkeypatch.setattr(simhash, "FRONTIER", 320)
    for limit in (1, 2, 3):
        got = {r["node"]: r["root"] for r in components(simhash.links(distinct, limit, shard_entries=60)).collect()}
        assert [got.get(f, f) for f in signed] == brute.components(signed, fps, limit)


def test_one_of_each_component_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long), (1, long), (1, long), (2, None), (5, ""), (7, "other words in here"), (None, "lone text without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.keep_one(docs).collect()) == [(0, rows[-1][1]), (1, long), (2, ""), (7, rows[-2][1])]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a int, b int")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
