import base64
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from plumbline.llm import byte_pairs
from plumbline.llm.pieces import public_path
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "a" * 3000, " " * 2000, "=-" * 600, "\n \n\t x", "'s''s it's I'LL", "x" * 300 + " " + "日本" * 200, "\x1c\x1d a\x1f b", "a \n\nb  c", "a 　\n b  \n\n  c\t\td", "\r\n\r\n a", "<|endoftext|> a<|endoftext|>", "é 😀👩‍👩‍👧 ½"]


def encoding(path, pattern):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(byte_pairs.read_ranks(path)) if p}, special_tokens={})


def digests(encoder, text):
    ids = encoder.encode_ordinary(text or "")
    return len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha(encoder.decode_bytes(ids))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_the_librarys(spark, name):
    path, pattern = public_path(name), byte_pairs.public_pattern()
    encoder, draw = encoding(path, pattern), random.Random(2)
    given = ODD + ["".join(draw.choices(" abinthegoTEq\n日é1.,'", k=draw.randint(0, 70))) for _ in range(300)] + [chr(c) + "x " + chr(c) for c in range(0x80, 0x3000, 7)]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("words", "sizes", "line", "n", "block")}).repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in byte_pairs.id_digests(docs, path, pattern, block_bytes=3000).collect()}
    for i, t in enumerate(given):
        assert got[i] == digests(encoder, t), repr(t)


def test_whole_query(spark):
    encoder = encoding(public_path("byte_bpe_50k.tiktoken"), byte_pairs.public_pattern())
    got = byte_pairs.op13_byte_pairs(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    wanted = [(r["doc_id"], *digests(encoder, r["text"])) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def small_vocabulary(tmp_path, tokens):
    """Bytes, then tokens in their order, in a file."""
    made = [bytes([b]) for b in range(256)] + [t.encode() for t in tokens]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(made)))
    return str(path)


@pytest.mark.parametrize("seed", range(3))
def test_vocabularies_in_any_order(spark, tmp_path, seed):
    """Tokens that come before their own parts, or can't be reached by merges, in short and long words."""
    draw = random.Random(seed)
    tokens = list(dict.fromkeys("".join(draw.choices("abc", k=draw.randint(2, 5))) for _ in range(60)))
    path, pattern = small_vocabulary(tmp_path, tokens), byte_pairs.public_pattern()
    encoder = encoding(path, pattern)
    given = ["".join(draw.choices("abc", k=draw.choice([3, 10, 30, 100, 200]))) for _ in range(150)] + tokens + ["ab" * 200, "a" * 333, "abcab" * 60]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in byte_pairs.with_ids(docs.withColumn("lang", F.lit("x")), path, pattern, more=("lang",)).collect()}
    for i, t in enumerate(given):
        assert rows[i]["ids"] == encoder.encode_ordinary(t) and bytes(rows[i]["decoded"]) == t.encode() and rows[i]["lang"] == "x", t


def test_what_is_refused(spark, tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        byte_pairs.read_ranks(str(tmp_path / "few"))
    with pytest.raises(ValueError):
        byte_pairs.check_pattern(r"\S+\s*")
    byte_pairs.check_pattern(byte_pairs.public_pattern())


def test_tables_without_a_word(spark):
    docs = spark.createDataFrame([(1, ""), (None, None)], "doc_id long, text string")
    path, pattern = public_path("byte_bpe_50k.tiktoken"), byte_pairs.public_pattern()
    assert {(r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in byte_pairs.with_ids(docs, path, pattern).collect()} == {(1, (), b""), (None, (), b"")}
    assert byte_pairs.id_digests(docs.limit(0), path, pattern).count() == 0


def test_a_block_is_the_patterns_words():
    """Of texts with white space of all kinds, beside each other in a block."""
    draw, pattern = random.Random(5), byte_pairs.public_pattern()
    texts = [t or "" for t in ODD] + ["".join(draw.choices("ab  \n\t\0\x85é1'.", k=draw.randint(0, 12))) for _ in range(2000)]
    texts += ["lone blanks\nand ends", " a", "a ", "\na", "a\n", " ", "\n", "\0", "a\0 b"]
    block = byte_pairs._Words(pattern)
    for t in texts:
        block.add(t)
    row = {k: v[0].as_py() for k, v in block.row().items()}
    line, at = byte_pairs.grown(row["line"], row["n"]), 0
    for t, n in zip(texts, byte_pairs.grown(row["sizes"], len(texts)).tolist(), strict=True):
        assert [row["words"][i] for i in line[at : at + n]] == block.pattern.findall(t), repr(t)
        at += n
    assert at == row["n"] and len(set(row["words"])) == len(row["words"])


def test_a_document_costs_what_it_has(spark, monkeypatch):
    """Where the words of a block begin is found once for the block, not again for each of its documents."""
    asked = []
    whole = byte_pairs.joined_back

    def counted(blocks, columns, found, run, schema):
        def seen(*given):
            class Lengths(np.ndarray):
                def cumsum(self, *a, **k):
                    asked.append(len(self))
                    return super().cumsum(*a, **k)

            row, lengths, ids, other = given
            return run(row, lengths.view(Lengths), ids, other)

        monkeypatch.setattr(byte_pairs, "counted_run", seen, raising=False)
        return whole(blocks, columns, found, run, schema)

    monkeypatch.setattr(byte_pairs, "joined_back", counted)
    byte_pairs.id_digests(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), public_path("byte_bpe_50k.tiktoken"), byte_pairs.public_pattern())
    block = byte_pairs._Words(byte_pairs.public_pattern())
    for i in range(50):
        block.add(f"a{i} b{i} c{i}")
    row = block.row() | {"_own_doc_id": pa.array([list(range(50))])}
    n = len(row["words"][0])
    made = byte_pairs.counted_run(row, np.ones(n, np.int64), np.arange(n), {})
    assert made.num_rows == 50 and set(made.column("n_tokens").to_pylist()) == {6} and asked.count(n) == 1
