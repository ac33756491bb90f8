"""SentencePiece encoding and decoding through a table of distinct chunks.

In the model no piece holds a white-space marker behind another character, so no piece crosses from one marked word into
the next: a text is cut before each run of markers, each distinct chunk is segmented once, and its ids are joined back
by position. The model puts one marker before a text; a chunk, which begins with a marker, is therefore handed to the
library without its first.

Each run of documents becomes a block: its distinct chunks, and each document as positions among them. The distinct chunks
of all blocks come together by chunk, each is segmented once for the corpus, and its ids come back to the blocks by
position. Texts and blocks are not shuffled, distinct chunks are.

That a model is of this kind is checked at the start: one with pieces that cross markers, or that treats white space in
another way, is refused.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.blocks import BLOCK_BYTES, as_rows, by_frequency, gathered, grown, joined_back, looked_up, numbering, shrunk
from plumbline.llm.common import id_and_text, table

MARKER = "▁"
#: A run of markers or spaces (the library takes them for the same) with what follows up to the next run.
CHUNK = re.compile(f"[ {MARKER}]+[^ {MARKER}]*")

_models: dict[str, object] = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def chunks(text: str) -> list[str]:
    """Chunks of a text, each with the marker that the model begins with; their first characters are that marker's."""
    return CHUNK.findall(" " + text) if text else []


def segmented(of: list[str], model) -> tuple[list[list[int]], list[str]]:
    """Ids of each chunk, and what they decode to with the chunk's first space."""
    # one marker alone: the library adds none to an empty text
    alone = [model.piece_to_id(MARKER)]
    ids = iter(model.encode([c[1:] for c in of if len(c) > 1], num_threads=1))
    ids = [next(ids) if len(c) > 1 else alone for c in of]
    said = model.decode(ids, num_threads=1) if ids else []
    return ids, [" " + (x if len(c) > 1 else "") for c, x in zip(of, said, strict=True)]


def check_model(path: str) -> None:
    """Raises ValueError for a model whose texts can't be segmented chunk by chunk."""
    model = _model(path)
    if any(MARKER in model.id_to_piece(i).lstrip(MARKER) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))):
        raise ValueError(f"{path}: pieces cross white-space markers")
    for text in ("a", " a", "a  b ", "\ta\nb", "▁a▁▁b", "A ﬁ é e\u0301", " ", "x   "):
        ids, said = segmented(chunks(text), model)
        if [i for x in ids for i in x] != model.encode(text) or "".join(said)[1:] != model.decode(model.encode(text)):
            raise ValueError(f"{path}: {text!r} is not what its chunks are")


class _Chunks:
    """A block's documents as positions among its distinct chunks."""

    kinds = {"chunks": "array<string>", "sizes": "binary", "line": "binary", "n": "long"}

    def __init__(self) -> None:
        self.number, self.sizes, self.line = numbering(), [], []

    def add(self, text: str) -> None:
        found = chunks(text)
        self.sizes.append(len(found))
        self.line.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))

    def row(self) -> dict[str, pa.Array]:
        line, strings = by_frequency(np.concatenate(self.line), list(self.number))
        return {"chunks": pa.array([strings], pa.list_(pa.string())), "sizes": pa.array([shrunk(np.array(self.sizes))], pa.binary()), "line": pa.array([shrunk(line)], pa.binary()), "n": pa.array([len(line)], pa.int64())}


def plain(chunk: str) -> str:
    """What most chunks decode to."""
    return chunk.replace(MARKER, " ")


def segment_once(blocks: DataFrame, model: str) -> DataFrame:
    """Ids of the distinct chunks, and what they decode to where that is not plain, packed for their blocks."""

    def make():
        of = _model(model)

        def rows(strings: list[str]) -> tuple[list[list[int]], list[str | None]]:
            ids, said = segmented(strings, of)
            return ids, [None if t == plain(c) else t for c, t in zip(strings, said, strict=True)]

        return rows

    return looked_up(blocks, "chunks", make)


def _documents(row: dict, columns: tuple[str, ...]) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """(the columns of a block's documents, chunks of each, positions of the chunks)."""
    kept = [row[_own(c)][0].values for c in columns]
    return kept, grown(row["sizes"][0].as_py(), len(kept[0])).astype(np.int64), grown(row["line"][0].as_py(), row["n"][0].as_py()).astype(np.int64)


def _prepared(docs: DataFrame, model: str, columns: tuple[str, ...], block_bytes: int) -> tuple[DataFrame, DataFrame, str]:
    """Blocks, in which a column c is _own_c, their chunks' ids, and the kinds of those columns."""
    check_model(model)
    named = [_own(c) for c in columns]
    own = id_and_text(docs, *columns[1:]).select(*[F.col(c).alias(n) for c, n in zip(columns, named, strict=True)], "text")
    blocks = as_rows(own, tuple(named), _Chunks, _Chunks.kinds, block_bytes)
    return blocks, segment_once(blocks, model), "".join(f"`{n}` {own.schema[n].dataType.simpleString()}, " for n in named)


def _own(column: str) -> str:
    return f"_own_{column}"


def with_pieces(docs: DataFrame, model: str, block_bytes: int = BLOCK_BYTES, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in more, ids (array<int>) and decoded (what the ids decode to) of each row of docs.

    Null texts count as empty: no ids, empty decoded text. Rows are independent: repeated rows and repeated or null
    doc_ids come out as they are. Texts are taken whole, however long; a block has one text at least. An empty table gives an
    empty result. Only the columns named are read; no name can clash, but for ids and decoded.
    """
    columns = ("doc_id", *more)

    def run(row: dict, lengths: np.ndarray, ids: np.ndarray, other: dict) -> pa.Table:
        kept, sizes, line = _documents(row, columns)
        end = np.cumsum(sizes)
        offset = np.concatenate([[0], np.cumsum(lengths[line])])[np.concatenate([[0], end])].astype(np.int32)
        said = _said(row, other)[line]
        texts = ["".join(said[a:z])[1:] for a, z in zip((end - sizes).tolist(), end.tolist(), strict=True)]
        flat = pa.array(gathered(ids, lengths, line).astype(np.int32))
        return pa.Table.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offset), flat), pa.array(texts, pa.string())], names=[*map(_own, columns), "ids", "decoded"])

    blocks, found, carried = _prepared(docs, model, columns, block_bytes)
    made = joined_back(blocks, [*map(_own, columns), *_Chunks.kinds], found, run, carried + "ids array<int>, decoded string")
    return made.withColumnsRenamed({_own(c): c for c in columns})


def piece_digests(docs: DataFrame, model: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs; cases as with_pieces has them."""

    def run(row: dict, lengths: np.ndarray, ids: np.ndarray, other: dict) -> pa.Table:
        kept, sizes, line = _documents(row, ("doc_id",))
        said, flat, at, digits = _said(row, other), ids.tolist(), 0, []
        for n in lengths.tolist():
            digits.append(",".join(map(str, flat[at : at + n])))
            at += n
        digits, end, out = np.array(digits, object), np.cumsum(sizes), []
        for a, z in zip((end - sizes).tolist(), end.tolist(), strict=True):
            part = line[a:z]
            out.append((int(lengths[part].sum()), sha256(",".join(digits[part])), sha256("".join(said[part])[1:])))
        return pa.Table.from_arrays([*kept, *[pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]], names=[_own("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256"])

    blocks, found, carried = _prepared(docs, model, ("doc_id",), block_bytes)
    made = joined_back(blocks, [_own("doc_id"), *_Chunks.kinds], found, run, carried + "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed(_own("doc_id"), "doc_id")


def _said(row: dict, other: dict) -> np.ndarray:
    """What each distinct chunk of a block decodes to."""
    said = np.array([plain(c) for c in row["chunks"][0].as_py()], object)
    for place, text in other.items():
        said[place] = text
    return said


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))
