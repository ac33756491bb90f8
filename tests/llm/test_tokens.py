import random

import pytest

from plumbline.llm import blocks, pieces, token_counts
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "▁▁a", " ▁ a▁b ", "\t", "a\tb\n\nc", "\r\n", "ünï çödé", "日本語 テキスト", "😀 emoji 👩‍👩‍👧", "\x00a", "<s> </s> <unk> [CLS] [UNK] [SEP]", "a[SEP]b", " nbsp　wide", "a\x1cb\x1fc", "é é", "​zero", "x" * 5000, "ab " * 3000, "﻿bom", "١٢٣ ½ ﬁ", "퟿"]


def texts(spark):
    draw = random.Random(3)
    made = ["".join(draw.choices(" ▁ab\tcdé\n<s>日.,'’-1 ", k=draw.randint(0, 60))) for _ in range(500)]
    return ODD + made + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    path = pieces.public_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    given = [*texts(spark), None]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.piece_digests(docs, path, block_bytes=20_000).collect()}
    whole = {r["doc_id"]: r for r in pieces.with_pieces(docs, path).collect()}
    for i, t in enumerate(given):
        ids = model.encode(t or "")
        assert whole[i]["ids"] == ids and whole[i]["decoded"] == model.decode(ids), repr(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(model.decode(ids))), repr(t)


def test_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = pieces.public_path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    given = [*texts(spark), None]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, path, block_bytes=20_000).collect()}
    for i, t in enumerate(given):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048), repr(t)


@pytest.mark.parametrize("share", [2, 1000])
def test_each_distinct_string_is_looked_up_once(spark, share):
    """Whatever the blocks, batches and shares; each block gets what its strings are."""
    docs = spark.createDataFrame(list(enumerate(["the cat's the cat", "the dog the", "cat"] * 40)), "doc_id long, text string").repartition(5)
    made = blocks.as_rows(pieces.id_and_text(docs), ("doc_id",), pieces._Chunks, pieces._Chunks.kinds, 100)
    assert made.count() > 10
    seen = spark.sparkContext.accumulator(0)

    def make():
        def of(strings):
            seen.add(len(strings))
            return [[len(x), 7] for x in strings], [x if "dog" in x else None for x in strings]

        return of

    def run(row, lengths, numbers, texts):
        said = row["chunks"][0].as_py()
        fine = lengths.tolist() == [2] * len(said) and numbers.tolist() == [n for x in said for n in (len(x), 7)] and texts == {i: x for i, x in enumerate(said) if "dog" in x}
        return blocks.pa.table({"fine": [fine]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = blocks.looked_up(made, "chunks", make, share)
        assert {r["fine"] for r in blocks.joined_back(made, ["chunks"], found, run, "fine boolean").collect()} == {True}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen.value == 4  # the, cat, cat's, dog


def test_other_models_are_refused():
    for name in ("byte_bpe_50k.json",):
        with pytest.raises(ValueError):
            token_counts.PreTokens(token_counts.public_path(name)).check()
    pieces.check_model(pieces.public_path("piece_bpe_32k.model"))


def test_tables_without_a_word(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (None, " \n")], "doc_id long, text string")
    path = pieces.public_path("piece_bpe_32k.model")
    assert {(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, token_counts.public_path("word_bpe_49k.json")).collect()} == {(1, 0), (2, 0), (None, 0)}
    some = docs.where("doc_id is not null")
    assert {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in pieces.with_pieces(some, path).collect()} == {(1, (), ""), (2, (), "")}
    assert {r["n_tokens"] for r in pieces.piece_digests(some, path).collect()} == {0}
