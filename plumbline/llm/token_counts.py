"""Token counts from pre-token frequencies, without ids.

A text is cut at white space, which the tokenizer drops, and its words are cut into pre-tokens by the tokenizer's own
normaliser and pre-tokeniser, once for each distinct word of a block of documents; a special string inside a word is one
token, as the library has it. The distinct pre-tokens of all blocks come together by pre-token, and the tokenizer's model
counts the pieces of each once for the corpus. The counts come back to the blocks, where each document's frequencies of words, and through them of
pre-tokens, are multiplied with them and summed.

That a tokenizer is of this kind is checked at the start: others are refused.
"""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.blocks import BLOCK_BYTES, as_rows, grown, joined_back, looked_up, numbering, shrunk
from plumbline.llm.common import id_and_text, table
from plumbline.llm.pieces import public_path

LIMIT = 2048
#: White space as the tokenizer's own patterns take it.
SPACE = regex.compile(r"\p{White_Space}+")
#: What str.split() takes for white space but the tokenizer doesn't.
ODD = "\x1c\x1d\x1e\x1f"


class PreTokens:
    """A tokenizer's special strings, pre-tokens and pieces."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = list(self.tokenizer.get_added_tokens_decoder().values())
        special = sorted((t.content for t in self.added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")

    def of(self, word: str) -> tuple[int, list[str]]:
        """(special strings in a word, its pre-tokens)."""
        parts = self.special.split(word)
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        return len(parts) - 1, [p for part in parts if part for p, _ in cut.pre_tokenize_str(normal.normalize_str(part) if normal else part)]

    def pieces(self, pretoken: str) -> int:
        return len(self.tokenizer.model.tokenize(pretoken))

    def count(self, text: str) -> int:
        found = [self.of(w) for w in words(text)]
        return sum(n + sum(map(self.pieces, ps)) for n, ps in found)

    def check(self) -> None:
        """Raises ValueError where texts can't be counted pre-token by pre-token."""
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in self.added) or not self.tokenizer.pre_tokenizer:
            raise ValueError("the tokenizer's special strings reach beyond themselves, or it has no pre-tokens")
        inside = "".join(t.content for t in self.added[:2])
        for text in ("a", " a  b\tc\n\n", "it's I'LL x's", "Don't 12ab, (x)...", "é e\u0301 日本 ½", f"a{inside}b {inside}", "\u00a0x\u3000y"):
            if self.count(text) != len(self.tokenizer.encode(text, add_special_tokens=False).ids):
                raise ValueError(f"{text!r} has other tokens than its pre-tokens")


def words(text: str) -> list[str]:
    return [w for w in SPACE.split(text) if w] if any(c in text for c in ODD) else text.split()


_loaded: dict[str, PreTokens] = {}


def _pretokens(path: str) -> PreTokens:
    if path not in _loaded:
        _loaded[path] = PreTokens(path)
    return _loaded[path]


class _Frequencies:
    """A block's documents as frequencies of its distinct words, and the words as positions among its distinct pre-tokens."""

    kinds = {"pretokens": "array<string>", "sizes": "binary", "held": "binary", "times": "binary", "special": "binary", "lengths": "binary", "line": "binary", "n": "array<int>"}

    def __init__(self, path: str) -> None:
        self.of, self.number, self.sizes, self.held, self.times = _pretokens(path), numbering(), [], [], []

    def add(self, text: str) -> None:
        found = Counter(words(text))
        self.sizes.append(len(found))
        self.held.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.times.append(np.fromiter(found.values(), np.int32, len(found)))

    def row(self) -> dict[str, pa.Array]:
        number, special, lengths, line = numbering(), [], [], []
        for word in self.number:
            n, own = self.of.of(word)
            special.append(n), lengths.append(len(own))
            line += [number[p] for p in own]
        held = np.concatenate(self.held)
        packed = {"sizes": self.sizes, "held": held, "times": np.concatenate(self.times), "special": special, "lengths": lengths, "line": line}
        made = {k: pa.array([shrunk(np.array(v, np.int32))], pa.binary()) for k, v in packed.items()}
        return {"pretokens": pa.array([list(number)], pa.list_(pa.string())), **made, "n": pa.array([[len(held), len(special), len(line)]], pa.list_(pa.int32()))}


def count_once(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of the distinct pre-tokens, packed for their blocks."""
    return looked_up(blocks, "pretokens", lambda: lambda strings: ([[_pretokens(tokenizer).pieces(x)] for x in strings], [None] * len(strings)))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs.

    Null texts count as empty: 0 bytes, 0 tokens. Rows are independent: repeated rows and repeated or null doc_ids come
    out as they are. Texts are taken whole, however long. An empty table gives an empty result. Only doc_id and text are
    read.
    """
    _pretokens(tokenizer).check()
    own = id_and_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    blocks = as_rows(own, ("doc_id", "n_bytes"), lambda: _Frequencies(tokenizer), _Frequencies.kinds, block_bytes)

    def run(row: dict, lengths: np.ndarray, pieces: np.ndarray, other: dict) -> pa.Table:
        ids, n_bytes = (row[c][0].values for c in ("doc_id", "n_bytes"))
        n_held, n_words, n_line = row["n"][0].as_py()
        part = lambda c, n: grown(row[c][0].as_py(), n).astype(np.int64)
        sums = lambda x, sizes: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(sizes)])])
        of_word = part("special", n_words) + sums(pieces[part("line", n_line)], part("lengths", n_words))
        tokens = sums(of_word[part("held", n_held)] * part("times", n_held), part("sizes", len(ids)))
        return pa.Table.from_arrays([ids, n_bytes, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = own.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "n_bytes", *[c for c in _Frequencies.kinds if c != "pretokens"]]
    return joined_back(blocks, columns, count_once(blocks, tokenizer), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
