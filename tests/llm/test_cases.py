"""Nulls, empty tables, repeated rows and columns with clashing names, for all operators; the whole pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import byte_pairs, decontamination, lm_scoring, merkle, periodic_runs, pieces, quality, sharding, simhash, suffix_array, token_counts, toxicity, url_filter
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
CLASHING = "key host words line block id body start end fp component_id least root n_words n_hit matches shard slot size spot share held counts docs label h p s t _0 _1 kept removed own_id stay_id url page_id".split()
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
ROWS = [(1, "some text with several words in it", "en", "a", 34), (1, "some text with several words in it", "en", "a", 34), (2, None, None, None, None), (None, "", "en", None, 0), (3, LONG, "de", "b", 1), (4, LONG + " end", "de", "b", 1), (None, "some text with several words in it", "en", "a", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (None, "some text"), (3, None)], "item_id long, text string")


OPERATORS = {
    "suffix_array": lambda d: suffix_array.repeat_report(d),
    "drop_repeats": lambda d: suffix_array.drop_repeats(d).select(SCHEMA_COLUMNS),
    "simhash": lambda d: simhash.near_duplicates(d),
    "keep_one": lambda d: simhash.keep_one(d).select(SCHEMA_COLUMNS),
    "pieces": lambda d: pieces.piece_digests(d, pieces.public_path("piece_bpe_32k.model")),
    "with_pieces": lambda d: pieces.with_pieces(d, pieces.public_path("piece_bpe_32k.model"), more=("lang", "source")).selectExpr("doc_id", "lang", "source", "size(ids) as n", "md5(decoded) as m"),
    "decontamination": lambda d: decontamination.decontamination_report(d, bench(d.sparkSession)),
    "drop_contaminated": lambda d: decontamination.drop_contaminated(d, bench(d.sparkSession)).select(SCHEMA_COLUMNS),
    "toxicity": lambda d: toxicity.toxicity(d, labels(d.sparkSession)),
    "lm_scoring": lambda d: lm_scoring.score_documents(d).selectExpr("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 3) as base_score"),
    "sharding": lambda d: sharding.shard_documents(d),
    "url_filter": lambda d: url_filter.filter_urls(d.drop("page_id", "url").withColumnsRenamed({"doc_id": "page_id", "text": "url"}), url_filter.rules_table(d.sparkSession)),
    "token_counts": lambda d: token_counts.token_counts(d, token_counts.public_path("word_bpe_49k.json")),
    "clashing_pieces": lambda d: pieces.with_pieces(d.withColumns({c: F.col("lang") for c in ("n", "block", "chunks", "sizes", "line")}), pieces.public_path("piece_bpe_32k.model"), more=("n", "block", "chunks", "sizes", "line")).selectExpr("doc_id", "n", "line", "size(ids) as k"),
    "byte_pairs": lambda d: byte_pairs.id_digests(d, byte_pairs.public_path("byte_bpe_50k.tiktoken"), byte_pairs.public_pattern()),
    "merkle": lambda d: merkle.manifest(d),
    "periodic_runs": lambda d: periodic_runs.run_digests(d),
    "quality": lambda d: quality.quality_rules(d),
    "keep_good": lambda d: quality.keep_good(d).select(SCHEMA_COLUMNS),
}
SCHEMA_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FILTERS = {"drop_repeats", "keep_one", "drop_contaminated", "keep_good"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    plain = spark.createDataFrame(ROWS, SCHEMA)
    clash = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in ROWS], SCHEMA + "".join(f", `{c}` long" for c in CLASHING))
    run = OPERATORS[name]
    wanted = sorted(map(repr, run(plain).collect()))
    assert sorted(map(repr, run(clash).collect())) == wanted
    assert len(wanted) == len(ROWS) or name in FILTERS
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    judged = brute.quality([(d["text"], d["source"]) for d in docs], quality.LINE_LIMIT, quality.LEAST_SHARE)
    docs = [d | {"text": j[7]} for d, j in zip(docs, judged, strict=True) if j[6]]
    ids = [d["doc_id"] for d in docs]
    least = brute.components(ids, [brute.fingerprint(d["text"]) for d in docs])
    docs = [d for d, c in zip(docs, least, strict=True) if d["doc_id"] == c]
    bodies, masks = brute.repeats([d["text"] for d in docs], 200)
    left = []
    for d, b, m in zip(docs, bodies, masks, strict=True):
        text, at = "", 0
        for c in b.decode():
            n = len(c.encode())
            text += "" if any(m[at : at + n]) else c
            at += n
        if not any(m) or brute.WORD.search(text):
            left.append(d | {"text": text if any(m) else d["text"]})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = [d for d in left if not brute.contamination(d["text"], items)[1]]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.public_path("piece_bpe_32k.model"))
    wanted = {d["doc_id"]: model.encode(d["text"] or "") for d in left}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert {k: r["ids"] for k, r in got.items()} == wanted
    assert all(r["text"] == model.decode(wanted[k]) for k, r in got.items())


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_return_the_columns_of_documents(spark, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = stage[1](spark, docs, SMALL)
    assert made.schema.simpleString() == docs.schema.simpleString()


def test_values_of_odd_rows(spark):
    """Not only the same in clashing tables: what null, empty, repeated and very long texts give."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    long = ROWS[4][1]
    of = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    bodies, masks = brute.repeats([r[1] for r in ROWS], 200)
    wanted = [(r[0], len(b), sum(m), sum(bool(x) and not (k and m[k - 1]) for k, x in enumerate(m)), brute.sha(bytes(x for x, g in zip(b, m, strict=True) if not g))) for r, b, m in zip(ROWS, bodies, masks, strict=True)]
    assert of(suffix_array.repeat_report(docs)) == sorted(wanted, key=repr)
    fps = [brute.fingerprint(r[1]) for r in ROWS]
    assert sorted(r["fp"] for r in simhash.near_duplicates(docs).collect()) == sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    assert sorted((r["n_words"], r["kept"]) for r in quality.quality_rules(docs).collect()) == sorted((len((r[1] or "").split()), r[1] in (long, ROWS[5][1]) and bool(quality_kept(r[1]))) for r in ROWS)
    assert sorted(r["size"] for r in sharding.shard_documents(docs).collect()) == sorted(len((r[1] or "").encode()) + 8 for r in ROWS)
    assert sorted(r["n_words"] for r in decontamination.decontamination_report(docs, bench(spark)).collect()) == sorted(len((r[1] or "").split()) for r in ROWS)
    assert len({r["severity"] for r in toxicity.toxicity(docs, labels(spark)).collect()}) == 1  # no feature stands in four texts
    assert sorted(r["n_tokens"] for r in lm_scoring.score_documents(docs).collect()) == sorted(len((r[1] or "").split()) + 1 for r in ROWS)


def quality_kept(text):
    return brute.quality([(text, "b")], quality.LINE_LIMIT, quality.LEAST_SHARE)[0][6]


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    body = " ".join(f"own{i} said{i * 7}" for i in range(80))
    rows = [(1, body, "en", "a", 5), (2, body, "en", "a", 5), (3, None, None, None, None), (4, "", "en", "a", 0), (None, body.replace("own", "other").replace("said", "told"), None, "b", 7), (5, LONG, "de", "b", 1)]
    for name, given in (("odd", rows), ("empty", [])):
        base = str(tmp_path / name)
        spark.createDataFrame(given, SCHEMA).write.parquet(f"{base}/documents.parquet")
        bench(spark).limit(0).write.parquet(f"{base}/benchmark.parquet")
        got = corpus_pipeline.run(spark, base).collect()
        if not given:
            assert got == []
            continue
        clash = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in given], SCHEMA + "".join(f", `{c}` long" for c in CLASHING))
        clash.write.parquet(f"{base}-clash/documents.parquet")
        bench(spark).limit(0).write.parquet(f"{base}-clash/benchmark.parquet")
        assert sorted(map(repr, corpus_pipeline.run(spark, f"{base}-clash").collect())) == sorted(map(repr, got))
        assert {r["doc_id"] for r in got} == {1, None}
        assert next(r["text"] for r in got if r["doc_id"] == 1).startswith("own0 said0")
