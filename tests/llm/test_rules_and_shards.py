import binascii
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontamination, quality, sharding, url_filter
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_url_filters_as_sql(same_as_sql):
    same_as_sql(url_filter.op8_url_filters, url_filter.OP8_SQL)


def test_quality_as_sql(same_as_sql):
    same_as_sql(quality.op10_quality_rules, quality.OP10_SQL)


def test_nested_rules_and_odd_urls(spark):
    urls = ["http://www.example.com/en/a", "http://example.com/en/", "HTTPS://A.B.EXAMPLE.COM/EN/", "x://net/fr/q?u", "x://a.net/es/", "x://anet/es/", "x://exnet", "com", "", None, "://", "x://com", "x://com/#/en/", "x://notexample.com/en/", "x://example.com?/en/"]
    pages = spark.createDataFrame([(i, u, "c", "k") for i, u in enumerate(urls)] + [(0, urls[0], "c", "k")], "page_id long, url string, host string, key string")
    got = defaultdict(list)
    for r in url_filter.filter_urls(pages, url_filter.rules_table(spark)).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert len(got[0]) == 2
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = brute.re.match("[^/?#]*", rest)[0]
        path = brute.re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(brute.UPPER)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert got[i][0] == (host, path, best[1], best[2]), u


def test_quality_of_odd_texts(spark):
    line = "Common boilerplate line of this host"
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    rows = [(f"{line}\n{body(i)}", "a") for i in range(4)] + [(f"{line.upper()} \n" * 60 + "tail words", "a"), (None, None), ("", "a"), ("\n\n", None), ("x y z " * 40, "b"), (body(9), None), (body(9), None), ("a\x1cb\xa0c " + body(3), "b"), (f"{line}\n{body(50)}", "b")]
    docs = spark.createDataFrame([(i, t, s, "k", "h") for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, key string, host string")
    wanted = brute.quality(rows, 3, 0.3)
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, limit=3).collect()}
    for i, w in enumerate(wanted):
        assert tuple(got[i][1:]) == w[:7], i
    kept = {r["doc_id"]: r["text"] for r in quality.keep_good(docs, limit=3).collect()}
    assert kept == {i: w[7] for i, w in enumerate(wanted) if w[6]}
    assert quality.keep_good(docs, limit=3).columns == docs.columns


def test_lines_of_a_template_are_counted_in_each_document(spark):
    """Eight lines on 30 pages with two own lines, near the limit; copies of a page are one document."""
    template = "\n".join(" ".join(f"t{k}w{j}" for j in range(7)) for k in range(8))
    page = lambda i: f"{template}\nown line {i} one\nown line {i} two"
    rows = [(i, page(i), "a") for i in range(30)] + [(100 + i, page(0), "b") for i in range(30)] + [(200 + i, page(i), "c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = quality.frequent_lines(docs, 20).groupBy("host").agg({"line": "count"}).collect()
    assert [tuple(r) for r in found] == [("a", 8 * 30)]
    assert {r["doc_id"] for r in quality.quality_rules(docs, 20).where("kept").collect()} == {r[0] for r in rows if r[2] != "a"}


def test_decontamination_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in decontamination.op4_decontamination(spark, SMALL).collect()}
    assert any(r["contaminated"] for r in got.values())
    for r in docs:
        n, hit, named = brute.contamination(r["text"], items)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (n, hit, len(named), brute.sha(",".join(named)), hit > 0)


@pytest.mark.parametrize("block_words", [3, 1000])
def test_decontamination_of_odd_texts(spark, block_words):
    items = [(1, "a b c d"), (2, "x"), (3, None), (4, "..."), (10, "b c d e"), (10, "b c d e"), (5, "A a a a a"), (6, "é日 ok now then")]
    texts = ["z a b c d e z", "x-x", None, "", "a a a a a a a", "B.C,D!E", "É日 ok", "é日 OK now then", "a b c"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.decontamination_report(docs, bench, 4).collect()}
    more = {r["doc_id"]: r for r in decontamination.verbatim_matches(docs, bench, 4, block_words, shard_rows=3).collect()}
    for i, t in enumerate(texts):
        n, hit, named = brute.contamination(t, items, 4)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == (n, hit, len(named), brute.sha(",".join(named))), t
        assert more[i]["n_hit"] == hit and {m["item_id"] for m in more[i]["matches"]} == set(named)
    assert max(m["words"] for m in more[0]["matches"]) == 4


def test_a_benchmark_of_many_blocks_is_the_same(spark):
    """200 blocks and more, in passes: the rows of one block."""
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    some = docs.where("doc_id < 60")
    more = items.unionByName(items.select((F.col("item_id") + 10_000).alias("item_id"), F.concat(F.lit("no such words as these are "), "text").alias("text")))
    dealt, blocks = decontamination._block_rows(more, 30)
    assert blocks > 200
    of = lambda df: sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted({m["item_id"] for m in r["matches"]}))) for r in df.collect())
    kept = decontamination.KEPT
    decontamination.KEPT = 60
    try:
        assert of(decontamination.verbatim_matches(some, more, block_words=30)) == of(decontamination.verbatim_matches(some, more))
    finally:
        decontamination.KEPT = kept


@pytest.mark.parametrize(("shards", "copies"), [(1, 1), (5, 40), (24, 3)])
def test_shards_are_minimax(spark, shards, copies):
    rows = [(i, "text " * (i % 17) + str(i // copies)) for i in range(150)] + [(None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, shards, shares=4).collect()
    assert len(got) == len(rows) and len({r["shard"] for r in got} - set(range(shards))) == 0
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r["size"], r["text_crc32"]) for r in got) == Counter((len((t or "").encode()) + 8, binascii.crc32((t or "").encode())) for _, t in rows)
    spots = {(r["size"], r["text_crc32"]): r["h"] for r in docs.selectExpr("octet_length(coalesce(text, '')) + 8L as size", "crc32(coalesce(text, '')) as text_crc32", "xxhash64(coalesce(text, '')) as h").collect()}
    bytes_ = Counter()
    for r in got:
        bytes_[spots[r["size"], r["text_crc32"]]] += r["size"]
    order = [bytes_[k] for k in sorted(bytes_)]

    def needed(capacity):
        n, free = 0, 0
        for b in order:
            if b > free:
                n, free = n + 1, capacity
            free -= b
        return n

    most = max(Counter({s: sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)}).values())
    assert needed(most) <= shards
    assert most == max(order) or needed(most - 1) > shards


def test_shards_of_the_whole_table(spark):
    """The registered query against greedy filling of all groups in order, at the least capacity that suffices."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "octet_length(coalesce(text, '')) + 8L as size", "crc32(coalesce(text, '')) as crc", "xxhash64(coalesce(text, '')) as h").collect()
    bytes_ = Counter()
    for d in docs:
        bytes_[d["h"]] += d["size"]
    order = sorted(bytes_)

    def cuts(capacity):
        at, free, shards = {}, 0, 0
        for h in order:
            if bytes_[h] > free:
                shards, free = shards + 1, capacity
            free -= bytes_[h]
            at[h] = shards - 1
        return shards, at

    low, high = max(bytes_.values()), sum(bytes_.values())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if cuts(mid)[0] <= sharding.SHARDS else (mid + 1, high)
    wanted = cuts(low)[1]
    got = {r["doc_id"]: r for r in sharding.op7_sharding(spark, SMALL).collect()}
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (d["size"], d["crc"], "bytes", wanted[d["h"]], None)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
