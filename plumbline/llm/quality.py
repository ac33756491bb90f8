r"""Quality rules: cross-document line frequency, over measures of each text.

Words are ``[^\x20\x09-\x0D]+``. A line is normalised (A-Z lower-cased, runs of white space made one space, trimmed) and
hashed. For each host (the ``source`` column) the distinct documents that hold a line are counted: equal texts are one
document, all others count each, near copies too. Lines counted more often than the limit are removed; a document that
then has too few of its words is rejected.

All of it is DataFrame expressions. Lines shuffle as (host, line, text), 40 bytes each, dealt out by all three, and are
counted by host and line after partial aggregation, so that a line that a third of all documents share is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, table, text_key, written

#: A line found in more documents of a host than this is removed.
LINE_LIMIT = 20
#: A document is depleted when less than this share of its words is in lines that stay.
LEAST_SHARE = 0.3
LEAST_WORDS = 50
SPACES = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), f"[{SPACES}]+", " "))


def line_hash(line: Column) -> Column:
    return F.unhex(F.substring(F.md5(normal_line(line).cast("binary")), 1, 16))


#: Of a column h of hashes, one for each 3-word window: the positions of those found twice or more, ascending. The upper
#: 40 bits of each hash and its position make one long; a sorted array of longs has equal windows side by side. Where
#: the position needs over 24 bits, or different hashes agree in the upper 40, pairs of hash and position are sorted.
_PACKED = "sort_array(transform(h, (x, i) -> (x & -16777216L) | i))"
_PAIRS = "sort_array(transform(h, (x, i) -> struct(x, i)))"
_CLASH = "exists(sequence(1, greatest(size(s) - 1, 1)), j -> j < size(s) and shiftright(s[j - 1] ^ s[j], 24) = 0 and h[int(s[j - 1] & 16777215L)] <> h[int(s[j] & 16777215L)])"
_SAME = "filter(transform(s, (x, j) -> if((j > 0 and shiftright(s[greatest(j - 1, 0)] ^ x, 24) = 0) or (j < size(s) - 1 and shiftright(s[least(j + 1, size(s) - 1)] ^ x, 24) = 0), int(x & 16777215L), -1)), p -> p >= 0)"
_SAME_PAIRS = "filter(transform(t, (x, j) -> if((j > 0 and t[greatest(j - 1, 0)].x = x.x) or (j < size(t) - 1 and t[least(j + 1, size(t) - 1)].x = x.x), x.i, -1)), p -> p >= 0)"
#: A window covers 3 words, but for those that the next found window covers.
_COVERED = "aggregate(transform(p, (x, j) -> if(j < size(p) - 1, least(3, p[least(j + 1, size(p) - 1)] - x), 3)), 0L, (a, x) -> a + x)"


def text_or_empty() -> Column:
    return F.coalesce("text", F.lit(""))


def host() -> Column:
    return F.coalesce("source", F.lit("")).alias("host")


def key() -> Column:
    return text_key(text_or_empty()).alias("key")


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to the columns in more and text."""
    split = docs.select(*more, text_or_empty().alias("text")).withColumn("words", words(F.col("text")))
    counted = split.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(rf"filter(split(text, '\n'), x -> x rlike '[^{SPACES}]')".replace("\\", "\\\\")).alias("full_lines"),
        F.expr("if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, greatest(size(words) - 3, 0)), i -> xxhash64(words[i], words[i + 1], words[i + 2])))").alias("h"),
    ).drop("words")
    # most texts have no window twice; the sorting is for the others
    again = counted.withColumn("h", F.expr("if(size(array_distinct(h)) = size(h), cast(array() as array<bigint>), h)"))
    fits = again.withColumn("s", F.expr(f"if(size(h) > 16777215, cast(array() as array<bigint>), {_PACKED})"))
    clear = fits.withColumn("t", F.expr(f"if(size(h) > 16777215 or {_CLASH}, {_PAIRS}, cast(null as array<struct<x: bigint, i: int>>))"))
    found = clear.withColumn("p", F.expr(f"sort_array(if(t is null, {_SAME}, {_SAME_PAIRS}))"))
    return found.withColumn("n_repeat_words", F.expr(_COVERED)).withColumn("n_dup_lines", (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long")).drop("full_lines", "h", "s", "t", "p")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def frequent_lines(docs: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """host, key (hash of a whole text), line (hash), words: the lines of each text that its host has too often."""
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    held = docs.select(host(), key(), F.explode(F.transform(lines, lambda x: F.struct(line_hash(x).alias("line"), F.size(words(x)).cast("long").alias("words")))).alias("one"))
    rows = written(held.select("host", "key", "one.*"), "quality-lines")
    seen = rows.select("host", "line", "key").distinct()
    often = seen.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > limit)
    return rows.select("host", "key", "line", "words").join(often.select("host", "line"), ["host", "line"], "left_semi")


def judged(docs: DataFrame, more: list[str], limit: int = LINE_LIMIT, least_share: float = LEAST_SHARE) -> DataFrame:
    """docs' columns in more as _0, _1 and so on, host, key, the measures, base_failed, kept, and removed_lines (hashes)."""
    often = frequent_lines(docs, limit)
    copies = docs.groupBy(host(), key()).agg(F.count("*").alias("copies"))
    # copies of a text give the same rows; their words count once, but each repetition in the text counts
    lost = often.groupBy("host", "key").agg(F.sum("words").alias("words"), F.collect_set("line").alias("removed_lines"))
    lost = lost.join(copies, ["host", "key"]).select("host", "key", F.expr("words div copies").alias("removed"), "removed_lines")
    # written, as a filter on the verdict would otherwise be pushed below and evaluate the nested expressions anew
    rows = written(measured(docs, *[F.col(c).alias(f"_{i}") for i, c in enumerate(more)], host(), key()).drop("text"), "quality-measures")
    return (
        rows.join(lost, ["host", "key"], "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.coalesce("removed", F.lit(0)) >= F.lit(least_share) * F.col("n_words")))
    )


def quality_rules(docs: DataFrame, limit: int = LINE_LIMIT, least_share: float = LEAST_SHARE) -> DataFrame:
    """The measures and the verdict of each row of docs (doc_id, text, source).

    Null texts have no words and fail the base rules. A null source counts as the empty host. Repeated rows are judged
    alike and count as one document of their host. Texts are read whole, whatever their length; those of over 16 million
    windows are sorted as pairs. An empty table gives an empty result. Columns other than the three are not read.
    """
    return judged(docs, ["doc_id"], limit, least_share).select(F.col("_0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, limit: int = LINE_LIMIT, least_share: float = LEAST_SHARE) -> DataFrame:
    """The documents that are kept, without the lines that are removed; columns as they are, n_chars counted anew.

    Null and empty texts have too few words and go; equal texts of a host are one document and stay or go together; texts are
    taken whole, however long. An empty table gives an empty result. Names of columns cannot clash.
    """
    verdicts = judged(docs, [], limit, least_share).select("host", "key", "kept", "removed_lines")
    kept = verdicts.where("kept").groupBy("host", "key").agg(F.first("removed_lines").alias("removed_lines"))
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col("text").alias("text"), host(), key())
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(f"[^{SPACES}]") | ~F.array_contains("removed_lines", line_hash(x)))
    left = rows.join(kept, ["host", "key"]).withColumn("text", F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[new.get(c, F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
with d as (
  select row_number() over () as n, doc_id, coalesce(text, '') as text, coalesce(source, '') as host from documents
), m as (
  select *, list_filter(regexp_split_to_array(text, '[{SPACES}]+'), lambda w: w <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) as lines from d
), w3 as (
  select n, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w from m, unnest(range(1, len(words) - 1)) as r(i)
), again as (
  select n, i from (select *, count(*) over (partition by n, w) as c from w3) where c > 1
), covered as (
  select n, count(distinct i + k) as n_repeat_words from again, range(0, 3) as r(k) group by n
), base as (
  select m.n, doc_id, host, len(words) as n_words, length(regexp_replace(text, '[{SPACES}]+', '', 'g')) as word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(covered.n_repeat_words, 0) as n_repeat_words, len(words) < {LEAST_WORDS} or 100 * coalesce(covered.n_repeat_words, 0) > 50 * len(words) as base_failed
  from m left join covered using (n)
), l as (
  select n, host, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{SPACES}]+', ' ', 'g')) as y,
    substr(md5(y), 1, 16) as line, len(list_filter(regexp_split_to_array(x, '[{SPACES}]+'), lambda w: w <> '')) as words
  from (select n, host, unnest(lines) as x from m)
), often as (
  select host, line from (select distinct l.host, line, text from l join d using (n))
  group by all having count(*) > {LINE_LIMIT}
), lost as (
  select n, sum(words) as removed from l semi join often on l.host = often.host and l.line = often.line group by n
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words - coalesce(removed, 0) >= {LEAST_SHARE} * n_words as kept
from base left join lost using (n)
"""
