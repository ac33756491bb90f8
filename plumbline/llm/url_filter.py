"""URL filters: a sort-merge range join of urls with nested host rules.

A host is turned round into a key (``www.example.com`` becomes ``com.example.www.``), so that a host and all of its
subdomains are one interval of keys, ``[com.example., com.example/)``: ``/`` follows ``.`` in byte order. Intervals
nest or are disjoint. Urls and interval bounds are sorted together; the sweep keeps a stack of the rules that are
active. Every bound carries the stack that holds from there on (at a start its own chain of enclosing rules, at an end
the chain without itself), so the stack at a url is the last one seen, a running window.

The sweep runs apart for each top-level label, and within a label for each of ``salts`` shares of the urls; the bounds
of that label, which are few, go to each share. No host, however frequent, makes a large task, and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, table

#: The rules of the registered query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Shares of a label's urls: so many at least, and one for so many rows of the table.
SALTS, SHARE_ROWS = 64, 1_000_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def interval_bounds(rules: DataFrame) -> DataFrame:
    """Both ends of each rule host's interval: key, and the stack of rules from there on."""
    frames = (
        rules.where("host <> '' and path is not null")
        .select(host_key(ascii_lower("host")).alias("key"), F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("hosts"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("frame"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("frame")).alias("frames"))
    )
    own = frames.select("key", F.split("key", r"\.").alias("labels"))
    outer = own.select("key", F.explode(F.expr("transform(sequence(1, size(labels) - 1), n -> concat(array_join(slice(labels, 1, n), '.'), '.'))")).alias("outer"))
    chain = outer.join(frames.select(F.col("key").alias("outer"), "frames"), "outer").groupBy("key").agg(
        F.flatten(F.collect_list("frames")).alias("inside"), F.flatten(F.collect_list(F.when(F.col("outer") != F.col("key"), F.col("frames")))).alias("outside")
    )
    return chain.select(
        F.explode(F.array(F.struct("key", F.col("inside").alias("stack")), F.struct(F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("key"), F.col("outside").alias("stack")))).alias("bound")
    ).select("bound.*")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None) -> DataFrame:
    """page_id, host, path, rule (host and path; null if none fits) and verdict of each row of pages.

    Of the rules that fit a url the one with the longest text wins; between equally long ones the longer host, then
    the greater verdict (block over allow). Null urls and urls without ``://`` have an empty host and path, which no
    rule fits. Rows stay as they are: repeated rows are judged alike, an empty table gives an empty result, and of
    other columns than page_id and url nothing is read. Rules without a host or path fit nothing.
    """
    salts = salts or max(SALTS, pages.count() // SHARE_ROWS)
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
    urls = pages.select("page_id", "url").select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), share.alias("share"))
    bounds = interval_bounds(rules)
    stack = dict(bounds.dtypes)["stack"]
    events = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "share", "page_id", "host", "path", F.lit(None).cast(stack).alias("stack")).unionByName(
        bounds.select("key", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("share"), "stack"), allowMissingColumns=True
    )
    sweep = Window.partitionBy("label", "share").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("label", F.regexp_extract("key", "^([^./]*)", 1)).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    best = F.array_max(F.filter("active", lambda r: F.col("path").startswith(r["path"])))
    return seen.select("page_id", "host", "path", best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " as rules(host, path, verdict)")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_table(spark))


OP8_SQL = f"""
with rules(rule_host, rule_path, rule_verdict) as (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
parts as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), urls as (
  select row_number() over () as n, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), ranked as (
  select u.*, rule_host || rule_path as rule, rule_verdict,
    row_number() over (partition by n order by length(rule_host || rule_path) desc, length(rule_host) desc, rule_verdict desc) as place
  from urls u left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from ranked where place = 1
"""
