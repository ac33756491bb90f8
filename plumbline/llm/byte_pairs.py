"""Byte-level BPE encoding and decoding by Spark's higher-order functions over the corpus's distinct words.

A text is cut by the vocabulary's pattern into words. Each run of documents becomes a block: its distinct words, and each
document as positions among them. The distinct words of all blocks come together by a hash, and each is encoded once:
its bytes are an array, and ``aggregate`` folds merges over it, in each round the pair of neighbours of the least rank,
until no pair has a rank. The ranks are a literal of the plan. The ids' binary pieces are concatenated to what they decode
to. Ids and bytes come back to the blocks by position, where they are put together for each document.

Texts and blocks are not shuffled; distinct words are, packed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.blocks import BLOCK_BYTES, as_rows, by_frequency, gathered, grown, joined_back, looked_up_by, numbering, shrunk
from plumbline.llm.common import id_and_text, table
from plumbline.llm.pieces import public_path

#: A token is one character while words are merged: this far above its rank, and above what codes pairs of UTF-16.
FIRST, SURROGATES = 0x200, 0xD800
#: Marks of the literals' lists, below the first token and above any byte; what stands for no rank is above all tokens.
MARK, END, NONE = "Ā", "ā", "\U0010ffff"
#: Lists of each literal; an entry is looked for in the one that its characters name.
LISTS = 65_536
#: Bytes of a word from which equal pairs are merged at once, and rounds of merges that such a word has at a time.
LONG, RUN = 64, 32
#: Where a text is cut before its distinct parts meet the pattern: between a character and white space behind it, which no
#: word of a text crosses. Only texts without OTHER white space are cut so; the pattern cuts those that have it.
CUT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
OTHER_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_STATE = "struct<tokens:array<string>,ranks:array<string>>"


def read_ranks(path: str) -> list[bytes | None]:
    """Tokens by rank of a file that has a token in base64 and its rank in each line; ranks without a token are None."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if missing := [b for b in range(256) if bytes([b]) not in set(found.values())]:
        raise ValueError(f"{path}: no rank for the bytes {missing}")
    return [found.get(i) for i in range(max(found) + 1)]


def _named(value: Column, kind: str, of: Callable[[Column], Column]) -> Column:
    """of(value), of the given kind, with the value computed once."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: of(x))


def _token(rank: int) -> str:
    """The character of a token; they are in the order of their ranks, in Spark's order of strings too."""
    return chr(FIRST + rank + (0x800 if FIRST + rank >= SURROGATES else 0))


class Merges:
    """A vocabulary as literals of the plan, and Columns that encode and decode with them.

    Words are texts with a character for each byte (as_bytes). The literals are few and long strings, as they go to every
    task: lists of entries MARK, key, END and the character of a token, the key being a pair's two characters or a word.
    """

    def __init__(self, pieces: list[bytes | None], lists: int = LISTS) -> None:
        self.lists = lists
        number = {p: i for i, p in enumerate(pieces) if p is not None}
        # where a pair is not found, the character at the place that follows from that is NONE
        words, pairs = [""] * lists, [4 * NONE] * lists
        for token, rank in number.items():
            word = token.decode("latin-1")
            words[zlib.crc32(word.encode()) % lists] += f"{MARK}{word}{END}{_token(rank)}"
            for cut in range(1, len(token)):
                if token[:cut] in number and token[cut:] in number:
                    left, right = _token(number[token[:cut]]), _token(number[token[cut:]])
                    pairs[(31 * ord(left) + ord(right)) % lists] += f"{MARK}{left}{right}{END}{_token(rank)}"
        literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")
        # the optimizer folds these into literals
        self.words, self.pairs, self.bytes = literal(words, "string"), literal(pairs, "string"), literal([_token(number[bytes([b])]) for b in range(256)], "string")
        self.pieces = literal([None if p is None else base64.b64encode(p).decode() for p in pieces], "binary")

    def _pair(self, pairs: Column, left: Column, right: Column) -> Column:
        """What two neighbours merge into, which is also their rank; NONE where they don't."""
        entries = F.get(pairs, (31 * F.ascii(left) + F.ascii(right)) % self.lists)
        return F.substring(entries, F.position(F.concat(F.lit(MARK), left, right, F.lit(END)), entries) + 4, F.lit(1))

    def _ranks(self, pairs: Column, tokens: Column) -> Column:
        """The rank of each of the tokens with the next."""
        return F.transform(F.slice(tokens, 1, F.size(tokens) - 1), lambda x, i: self._pair(pairs, x, F.get(tokens, i + 1)))

    def _merged(self, pairs: Column, start: Column) -> Column:
        """What merges leave of tokens: in each round, the leftmost pair of least rank is merged."""

        def merged(now: Column, place: Column) -> Column:
            tokens, ranks = now["tokens"], now["ranks"]
            least, n, none = F.get(ranks, place - 1), F.size(tokens), F.array().cast("array<string>")
            before = F.when(place > 1, F.concat(F.slice(ranks, 1, place - 2), F.array(self._pair(pairs, F.get(tokens, place - 2), least)))).otherwise(none)
            after = F.when(place < n - 1, F.concat(F.array(self._pair(pairs, least, F.get(tokens, place + 1))), F.slice(ranks, place + 2, n))).otherwise(none)
            whole = F.struct(F.concat(F.slice(tokens, 1, place - 1), F.array(least), F.slice(tokens, place + 2, n)).alias("tokens"), F.concat(before, after).alias("ranks"))
            return F.when(place.isNull() | (least == NONE), now).otherwise(whole)

        def fold(now: Column, _: Column) -> Column:
            return _named(F.array_position(now["ranks"], F.array_min(now["ranks"])).cast("int"), _STATE, lambda place: merged(now, place))

        first = F.struct(start.alias("tokens"), self._ranks(pairs, start).alias("ranks"))
        # n tokens have n - 1 merges at most
        return F.aggregate(F.slice(start, 2, F.size(start)), first, fold, lambda now: now["tokens"])

    def _merged_at_once(self, pairs: Column, start: Column) -> Column:
        """As _merged, for long words: a round merges a pair everywhere, where that is what one merge after the other
        comes to: if no pair that stands meanwhile has a lower rank. Else it merges the leftmost alone."""

        def state(tokens: Column) -> Column:
            return _named(tokens, _STATE, lambda t: F.struct(t.alias("tokens"), self._ranks(pairs, t).alias("ranks")))

        def merge(now: Column, least: Column, place: Column) -> Column:
            left, right = F.get(now["tokens"], place - 1), F.get(now["tokens"], place)
            alone = F.concat(F.slice(now["tokens"], 1, place - 1), F.array(least), F.slice(now["tokens"], place + 2, F.size(now["tokens"])))
            # another pair of the same bytes, and so of the same rank
            other = F.size(F.filter(now["tokens"], lambda x, i: (F.get(now["ranks"], i) == least) & (x != left))) > 0

            def checked(after: Column) -> Column:
                lower = F.array_min(after["ranks"]) <= least
                # what stands for a moment between one merge and the next to its right
                between = F.contains(F.array_join(after["tokens"], ""), F.concat(least, least)) & (self._pair(pairs, least, left) < least)
                return F.when(F.coalesce(lower, F.lit(False)) | between | other, state(alone)).otherwise(after)

            every = F.split(F.replace(F.array_join(now["tokens"], ""), F.concat(left, right), least), "")
            return _named(state(every), _STATE, checked)

        def fold(now: Column, _: Column) -> Column:
            least = F.array_min(now["ranks"])
            return F.when(done(now), now).otherwise(merge(now, least, F.array_position(now["ranks"], least).cast("int")))

        done = lambda now: F.coalesce(F.array_min(now["ranks"]), F.lit(NONE)) == NONE
        # n tokens have n - 1 merges at most; they are dealt in runs, so that finished words have few rounds more
        runs = F.sequence(F.lit(0), F.floor(F.size(start) / RUN).cast("int"))
        run = lambda now, _: F.when(done(now), now).otherwise(F.aggregate(F.sequence(F.lit(1), F.least(F.size(now["tokens"]), F.lit(RUN))), now, fold))
        return F.aggregate(runs, state(start), run, lambda now: now["tokens"])

    def _ids(self, of: Column, word: Column) -> Column:
        """Ids of a word: its own, if it is a token, else those of what merges leave."""
        entries, marked = F.get(of["words"], (F.crc32(word.cast("binary")) % self.lists).cast("int")), F.concat(F.lit(MARK), word, F.lit(END))
        known = F.when(F.contains(entries, marked), F.substring(entries, F.position(marked, entries) + F.length(word) + 2, F.lit(1)))
        tokens = F.transform(F.split(word, ""), lambda c: F.get(of["bytes"], F.ascii(c)))
        merged = _named(tokens, "array<string>", lambda t: F.when(F.size(t) <= LONG, self._merged(of["pairs"], t)).otherwise(self._merged_at_once(of["pairs"], t)))
        number = lambda t: F.ascii(t) - FIRST - F.when(F.ascii(t) >= SURROGATES, 0x800).otherwise(0)
        return F.when(word == "", F.array().cast("array<int>")).when(known.isNotNull(), F.array(number(known))).otherwise(F.transform(merged, number))

    def encoded(self, words: Column) -> Column:
        """ids of each of the words."""
        literals = F.struct(self.words.alias("words"), self.pairs.alias("pairs"), self.bytes.alias("bytes"))
        return _named(literals, "array<array<int>>", lambda of: F.transform(words, lambda w: self._ids(of, w)))

    def decoded(self, ids: Column) -> Column:
        """The binary pieces of each list of ids in one; null where an id has none."""
        said = lambda pieces, some: F.unhex(F.array_join(F.transform(some, lambda i: F.hex(F.get(pieces, i))), "", "?"))
        return _named(self.pieces, "array<binary>", lambda pieces: F.transform(ids, lambda some: said(pieces, some)))


def as_bytes(word: Column) -> Column:
    """A text with a character for each of its UTF-8 bytes."""
    return F.decode(word.cast("binary"), "ISO-8859-1")


def cut(text: str, words: regex.Pattern) -> list[str]:
    """Parts of a text that words() of each part give the text's words."""
    odd = any(c in text for c in OTHER) or (not text.isascii() and any(c in text for c in OTHER_WIDE))
    return words.findall(text) if odd else CUT.findall(text)


def check_pattern(pattern: str) -> None:
    """Raises ValueError for a pattern that leaves out characters, or whose words cross from a character into white space."""
    words = regex.compile(pattern)
    for text in ("a b", "a  b\n\n c", "it's 12ab, (x)...\n", " a", "a ", "\n\na", "a\u00a0 b\t\n c", "日本 é e\u0301 ½", "'s''s ''"):
        found = words.findall(text)
        if "".join(found) != text or [w for part in cut(text, words) for w in words.findall(part)] != found:
            raise ValueError(f"{pattern}: {text!r} is not what its words are")


class _Words:
    """A block's documents as positions among its distinct words."""

    kinds = {"words": "array<string>", "sizes": "binary", "line": "binary", "n": "long"}

    def __init__(self, pattern: str) -> None:
        self.pattern, self.number, self.sizes, self.line = regex.compile(pattern), numbering(), [], []

    def add(self, text: str) -> None:
        found = cut(text, self.pattern)
        self.sizes.append(len(found))
        self.line.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))

    def row(self) -> dict[str, pa.Array]:
        number, lengths, flat = numbering(), [], []
        for part in self.number:
            own = self.pattern.findall(part)
            lengths.append(len(own))
            flat += [number[w] for w in own]
        parts, lengths = np.concatenate(self.line), np.array(lengths, np.int64)
        line, strings = by_frequency(gathered(np.array(flat, np.int32), lengths, parts), list(number))
        end = np.concatenate([[0], np.cumsum(lengths[parts])])
        sizes = np.diff(end[np.concatenate([[0], np.cumsum(self.sizes)])])
        return {"words": pa.array([strings], pa.list_(pa.string())), "sizes": pa.array([shrunk(sizes)], pa.binary()), "line": pa.array([shrunk(line)], pa.binary()), "n": pa.array([len(line)], pa.int64())}


def _made(merges: Merges) -> Callable[[Column], Column]:
    """Of an array of words: ids of each, and what they decode to where that is not the word."""

    def of(words: Column) -> Column:
        ids = merges.encoded(F.transform(words, as_bytes))
        with_bytes = _named(ids, "array<struct<numbers:array<int>,bytes:binary>>", lambda n: F.zip_with(n, merges.decoded(n), lambda i, b: F.struct(i.alias("numbers"), b.alias("bytes"))))
        differs = lambda made, w: F.when(~made["bytes"].eqNullSafe(w.cast("binary")), F.base64(made["bytes"]))
        return F.zip_with(with_bytes, words, lambda made, w: F.struct(made["numbers"].alias("numbers"), differs(made, w).alias("said")))

    return of


def _blocks(docs: DataFrame, pieces: list[bytes | None], pattern: str, columns: tuple[str, ...], block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    check_pattern(pattern)
    own = id_and_text(docs, *columns[1:])
    own = own.select(*[F.col(c).alias(f"_own_{c}") for c in columns], "text")
    blocks = as_rows(own, tuple(f"_own_{c}" for c in columns), lambda: _Words(pattern), _Words.kinds, block_bytes)
    return own, blocks, looked_up_by(blocks, "words", _made(Merges(pieces)))


def _joined(docs: DataFrame, path: str, pattern: str, columns: tuple[str, ...], block_bytes: int, each: Callable[[bytes, list[bytes]], tuple], kinds: dict[str, str], arrow: list[pa.DataType]) -> DataFrame:
    """The columns of each row of docs, and each(ids as little-endian 32-bit integers, the bytes of its words)."""
    own, blocks, found = _blocks(docs, read_ranks(path), pattern, columns, block_bytes)
    named = [f"_own_{c}" for c in columns]

    def run(row: dict, lengths: np.ndarray, ids: np.ndarray, other: dict) -> pa.Table:
        kept = [row[c][0].values for c in named]
        sizes = grown(row["sizes"][0].as_py(), len(kept[0])).astype(np.int64)
        line = grown(row["line"][0].as_py(), row["n"][0].as_py())
        said = np.array(row["words"][0].values.cast(pa.binary()).to_pylist(), object)
        for place, text in other.items():
            said[place] = base64.b64decode(text)
        end, begin, out = np.cumsum(sizes), np.cumsum(lengths) - lengths, []
        for a, z in zip((end - sizes).tolist(), end.tolist(), strict=True):
            part = line[a:z]
            out.append(each(gathered(ids, lengths, part, begin).astype("<u4").tobytes(), said[part].tolist()))
        made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), arrow, strict=True)]
        return pa.Table.from_arrays([*kept, *made], names=[*named, *kinds])

    schema = ", ".join([*[f"`{c}` {own.schema[c].dataType.simpleString()}" for c in named], *[f"{c} {t}" for c, t in kinds.items()]])
    made = joined_back(blocks, [*named, *_Words.kinds], found, run, schema)
    return made.withColumnsRenamed({f"_own_{c}": c for c in columns})


def with_ids(docs: DataFrame, ranks: str, pattern: str, block_bytes: int = BLOCK_BYTES, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in more, ids (array<int>) and decoded (binary: the ids' pieces in one) of each row of docs.

    ranks: a file of tokens (base64) and their ranks; pattern cuts texts into words. Null texts count as empty: no ids, no
    bytes. Rows are independent: repeated rows and repeated or null doc_ids come out as they are. Texts are taken whole,
    however long; a block has one text at least. An empty table gives an empty result. Only the columns named are read, and
    their names cannot clash with those of blocks.
    """
    each = lambda ids, said: (np.frombuffer(ids, "<u4").astype(np.int32).tolist(), b"".join(said))
    return _joined(docs, ranks, pattern, ("doc_id", *more), block_bytes, each, {"ids": "array<int>", "decoded": "binary"}, [pa.list_(pa.int32()), pa.binary()])


def id_digests(docs: DataFrame, ranks: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs; cases as with_ids has them."""
    each = lambda ids, said: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join(said)).hexdigest())
    return _joined(docs, ranks, pattern, ("doc_id",), block_bytes, each, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, [pa.int64(), pa.string(), pa.string()])


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_digests(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.tiktoken"), public_pattern())
