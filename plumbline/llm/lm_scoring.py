r"""LM scoring: a gated recurrent model with class-factored output scores whole documents.

Tokens are words ``[^\x20\x09-\x0D]+`` (A-Z lower-cased) and one end per document. Documents whose doc_id, as text, has a
CRC-32 of 1 modulo 5 are held out; from all others come the counts of all tokens, the vocabulary, the classes and the
gradients.

Documents are dealt to blocks of about ``BLOCK_BYTES`` by a hash of doc_id and text, and ordered by it within their
block, so blocks, and with them all scores, do not depend on how the table is stored. A block is one row: its distinct
tokens with their counts in its training documents, and each document as positions among them. Blocks are written once,
bucketed by block, and are not shuffled again.

The vocabulary's head has the ``HEAD`` most frequent words, which the driver and all tasks hold; every other token is in
the band of its count (0 and 1, 2 and 3, 4 to 7, and so on), which the model predicts as it does a word. Only distinct
tokens of blocks that are outside the head are shuffled, by token to their counts and by block back, so no row stands for
a frequent word and what is gathered grows with the corpus. A word has its band's probability times
(c + 0.5) / (n + 0.5 v), c its count, n and v the counts and kinds of the band's words; in the first band v has one more,
for words never seen.

The recurrent weights are fitted to all training documents, each once, at every size: in ``ROUNDS`` rounds, each over
every ``ROUNDS``-th block, side by side. Each block goes on by truncated backpropagation from the parameters so far, and
the changes are averaged, in whole numbers, so their order is of no consequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import gated_model
from plumbline.llm.common import id_and_text, kept_table, table, written

#: Words of the vocabulary's head, and how often such a word stands in training documents at least.
HEAD, LEAST_COUNT = 16_384, 4
BLOCK_BYTES = 16_000_000
#: Buckets of the table of blocks, at most.
MOST_BUCKETS = 20_000
ROUNDS = 4
#: Parameters in one row when changes are averaged, and the unit of a change.
STRETCH, UNIT = 1 << 17, 2.0**-12
#: Rows of a stretch are added up in so many shares before they come together.
SHARES = 32
FOLDS, HELD_FOLD = 5, 1
END = b""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


def _numbered(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, position of each token among them, tokens of each text)."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    words, end = found.flatten(), found.offsets.to_numpy()
    some = np.concatenate([[0], np.cumsum(pc.not_equal(words, "").to_numpy(zero_copy_only=False))])  # white space at an edge leaves empty ones
    size = np.diff(some[end]) + 1
    coded = words.filter(pc.not_equal(words, "")).dictionary_encode()
    line, ends = np.full(int(size.sum()), len(coded.dictionary), np.int32), np.cumsum(size) - 1
    inside = np.ones(len(line), bool)
    inside[ends] = False
    line[inside] = coded.indices.to_numpy()
    return pa.concat_arrays([coded.dictionary.cast(pa.large_binary()).cast(pa.binary()), pa.array([END], pa.binary())]), line, size


class _Block:
    def __init__(self) -> None:
        self.texts, self.held, self.docs, self.bytes = [], [], [], 0

    def add(self, doc_id: pa.Scalar, held: bool, text: pa.Scalar) -> None:
        self.docs.append(doc_id), self.held.append(held), self.texts.append(text.as_py())
        self.bytes += text.as_buffer().size + 1

    def record(self, block: int, id_type: pa.DataType) -> pa.RecordBatch:
        tokens, line, size = _numbered(self.texts)
        n = np.bincount(line[np.repeat(~np.array(self.held, bool), size)], minlength=len(tokens))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = {
            "block": pa.array([block], pa.int64()), "docs": one(pa.array(self.docs, id_type)), "held": one(pa.array(self.held, pa.bool_())), "sizes": one(pa.array(size, pa.int32())),
            "ids": pa.array([pa.compress(line.tobytes(), codec="zstd", asbytes=True)], pa.binary()), "tokens": one(tokens), "train": one(pa.array(n, pa.int64())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def fit_round() -> Column:
    return F.pmod("block", F.lit(ROUNDS)).cast("int")


def packed(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block: its documents, their tokens as positions among tokens, and training counts.

    docs: doc_id, text, held. Equal rows are dealt to one block, which goes on in blocks of its own where it is too large.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text") + F.lit(1).cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = min(blocks, MOST_BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, piece = _Block(), None, 0
        for batch in batches:
            id_type = batch.column("doc_id").type
            for deal, doc_id, held, text in zip(*[batch.column(c).to_pylist() for c in ("deal", "doc_id", "held")], batch.column("text"), strict=True):
                if block.docs and (deal != now or block.bytes >= 2 * block_bytes):
                    yield block.record(now + piece * blocks, id_type)
                    block, piece = _Block(), piece + 1 if deal == now else 0
                now = deal
                block.add(doc_id, held, text)
        if block.docs:
            yield block.record(now + piece * blocks, id_type)

    dealt = docs.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("deal", F.pmod("h", F.lit(blocks)))
    ordered = dealt.repartition(buckets, "deal").sortWithinPartitions("deal", "h", "doc_id").select("deal", "doc_id", "held", "text")
    made = ordered.mapInArrow(run, f"block long, docs array<{kind}>, held array<boolean>, sizes array<int>, ids binary, tokens array<binary>, train array<long>")
    return kept_table(made.withColumn("round", fit_round()), "blocks", "block", buckets, "round")


def token_counts(blocks: DataFrame) -> DataFrame:
    """token, c (above 0) of each token of training documents."""
    return blocks.select(F.explode(F.arrays_zip("tokens", "train")).alias("t")).where("t.train > 0").groupBy(F.col("t.tokens").alias("token")).agg(F.sum("t.train").alias("c"))


def band(c: np.ndarray) -> np.ndarray:
    """0 for counts of 0 and 1, 1 for 2 and 3, 2 for 4 to 7 and so on."""
    return np.frexp(np.maximum(c, 1).astype(float))[1] - 1


class Vocabulary:
    """The head's words by falling count, and counts (n) and kinds (v) of the words of each band."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: np.ndarray, v: np.ndarray) -> None:
        self.words, self.n = pa.array(words, pa.binary()), n
        self.share = n + 0.5 * (v + (np.arange(len(v)) == 0))
        self.counts = np.concatenate([counts, [0]]).astype(np.int64)
        self.layout = gated_model.Layout(counts, n)

    def looked_up(self, tokens: pa.Array, place: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each token. place, c: counts of tokens outside the head; other ones there were never seen."""
        number = pc.fill_null(pc.index_in(tokens, value_set=self.words), len(self.words)).to_numpy().astype(np.int64)
        counts = self.counts[number]
        counts[place] = c
        return np.where(number == len(self.words), len(self.words) + band(counts), number), counts


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """counts: token, c. The driver gets the head and one row for each band."""
    top = counts.where(F.col("c") >= LEAST_COUNT).orderBy(F.col("c").desc(), "token").limit(head).collect()
    words, c = [bytes(r["token"]) for r in top], np.array([r["c"] for r in top], np.int64)
    exponent = F.length(F.bin("c")) - 1
    rows = {r["band"]: (r["n"], r["v"]) for r in counts.groupBy(exponent.alias("band")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n, v = (np.array([rows.get(k, (0, 0))[i] for k in range(max(rows, default=0) + 1)], np.int64) for i in (0, 1))
    np.subtract.at(n, band(c), c)
    np.subtract.at(v, band(c), 1)
    # no word outside the head stands more often than those in it
    some = int(np.flatnonzero(v).max(initial=0)) + 1
    return Vocabulary(words, c, n[:some].astype(float), v[:some].astype(float))


def tail_counts(blocks: DataFrame, counts: DataFrame, words: list[bytes]) -> DataFrame:
    """block, place, c of the distinct tokens of each block that are outside the head and in training documents."""
    head = F.broadcast(blocks.sparkSession.createDataFrame([(bytearray(w),) for w in words], "token binary"))
    rows = blocks.select("block", F.posexplode("tokens").alias("place", "token")).join(head, "token", "left_anti")
    return rows.join(counts.join(head, "token", "left_anti"), "token").select("block", "place", "c", fit_round().alias("round"))


def _with_tail(blocks: DataFrame, columns: list[str], tail: DataFrame, run, schema: str) -> DataFrame:
    """run(a block, place, c) over all blocks. Only the tail is shuffled."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        right = right.combine_chunks()
        return run(left.combine_chunks().to_batches()[0], right.column("place").to_numpy(), right.column("c").to_numpy())

    empty = pa.Table.from_batches([], pa.schema([]))
    return blocks.select("block", *columns).groupBy("block").cogroup(tail.select("block", "place", "c").groupBy("block")).applyInArrow(both, schema)


def _line(batch: pa.RecordBatch, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each token, sizes of documents, positions among the distinct tokens) of a block."""
    size = batch.column("sizes")[0].values.to_numpy().astype(np.int64)
    ids = np.frombuffer(pa.decompress(batch.column("ids")[0].as_py(), int(size.sum()) * 4, "zstd", asbytes=True), np.int32)
    return number[ids], size, ids


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each stretch k."""
    sums: dict[int, list] = {}
    for batch in batches:
        for k, x, n, units in zip(*[batch.column(c).to_pylist() for c in ("k", "x", "n", "units")], strict=True):
            x = np.frombuffer(pa.decompress(x, STRETCH * 8, "zstd", asbytes=True), np.int64)
            if k not in sums:
                sums[k] = [np.zeros(STRETCH, np.int64), 0, 0]
            sums[k][0] += x
            sums[k][1] += n
            sums[k][2] += units
    for k, (x, n, units) in sums.items():
        yield _row(k, x, n, units)


def _row(k: int, x: np.ndarray, n: int, units: int) -> pa.RecordBatch:
    packed_x = pa.compress(x.tobytes(), codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed_x], pa.binary()), pa.array([n], pa.int64()), pa.array([units], pa.int64())], names=["k", "x", "n", "units"])


def fitted(blocks: DataFrame, tail: DataFrame, words: Vocabulary) -> tuple[dict[str, np.ndarray], int]:
    """Parameters after one pass over all training documents, and the tokens seen in it."""
    context, layout = blocks.sparkSession.sparkContext, words.layout
    p, seen, kinds = layout.start(), 0, "k int, x binary, n long, units long"
    vocabulary_ = context.broadcast(words)
    for r in range(ROUNDS):
        now = context.broadcast(p)

        def run(batch: pa.RecordBatch, place: np.ndarray, c: np.ndarray, now=now) -> pa.Table:
            line, size, _ = _line(batch, vocabulary_.value.looked_up(batch.column("tokens")[0].values, place, c)[0])
            end, held = np.cumsum(size), batch.column("held")[0].values.to_numpy(zero_copy_only=False)
            new, n = gated_model.train(now.value, vocabulary_.value.layout, [line[end[k] - size[k] : end[k]] for k in np.flatnonzero(~held)])
            change = np.rint((gated_model.flat(new) - gated_model.flat(now.value)) / UNIT).astype(np.int64)
            change = np.concatenate([change, np.zeros(-len(change) % STRETCH, np.int64)])
            return pa.Table.from_batches([_row(k, change[at : at + STRETCH], n, 1) for k, at in enumerate(range(0, len(change) if n else 0, STRETCH))], _row(0, change[:0], 0, 0).schema)

        some = F.col("round") == r
        changes = _with_tail(blocks.where(some), ["held", "sizes", "ids", "tokens"], tail.where(some), run, kinds).mapInArrow(_added, kinds)
        shares = changes.repartition("k", F.spark_partition_id() % SHARES).mapInArrow(_added, kinds)
        got = shares.repartition("k").mapInArrow(_added, kinds).orderBy("k").toArrow()
        if got.num_rows:
            x = np.concatenate([np.frombuffer(pa.decompress(v.as_py(), STRETCH * 8, "zstd", asbytes=True), np.int64) for v in got.column("x")])
            flat = gated_model.flat(p)
            p = gated_model.shaped(flat + x[: len(flat)] * (UNIT / got.column("units")[0].as_py()), p)
            seen += got.column("n")[0].as_py()
    return p, seen


def score_documents(docs: DataFrame, head: int = HEAD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row of docs.

    Null texts count as empty and have the end token only; a null doc_id is not held out. Repeated rows each count and
    are each scored. Texts are scored whole, however long. Without training documents base_score is 0 and score what an
    unfitted model gives; an empty table gives an empty result. Only doc_id and text are read.
    """
    plain = id_and_text(docs).withColumn("held", held_out(F.col("doc_id")))
    blocks = packed(plain, block_bytes)
    counts = written(token_counts(blocks), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    words = vocabulary(counts, head)
    tail = written(tail_counts(blocks, counts, words.words.to_pylist()), "lm-tail", "round")
    context = blocks.sparkSession.sparkContext
    model, vocabulary_ = context.broadcast(fitted(blocks, tail, words)[0]), context.broadcast(words)
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch, place: np.ndarray, c: np.ndarray) -> pa.Table:
        known = vocabulary_.value
        number, count_ = known.looked_up(batch.column("tokens")[0].values, place, c)
        base, head_words = np.log10((count_ + 0.5) / (n + 0.5 * (v + 1))), len(known.words)
        beside = np.where(number >= head_words, np.log10((count_ + 0.5) / known.share[np.maximum(number - head_words, 0)]), 0.0)
        line, size, ids = _line(batch, number)
        begin = np.cumsum(size) - size
        score = gated_model.log_likelihoods(model.value, known.layout, np.split(line, begin[1:])) / np.log(10) + np.add.reduceat(beside[ids], begin)
        made = [batch.column("held")[0].values, size, np.add.reduceat((count_[ids] > 0).astype(np.int64), begin), np.full(len(size), n, np.int64), np.add.reduceat(base[ids], begin), score]
        return pa.Table.from_arrays([batch.column("docs")[0].values, *map(pa.array, made)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _with_tail(blocks, ["docs", "held", "sizes", "ids", "tokens"], tail, run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
