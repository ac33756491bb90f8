"""Reports of PDFs with any number of sheets, as pieces that follow each other.

A batch report is one JSON document, but it never stands in one row: its lines (what opens and closes its lists, each sheet's
report, each id) are rows, which a range partition puts in order. A document is a folder whose files, one after the other
in the order of their names, are its text. A large PDF has many partitions, a small one shares its partition with others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sheets import report_columns

LISTS = ("compliant", "non_compliant", "undetermined")


def batch_lines(reports: DataFrame, base: str = "base", model: str = "mistral", reachable: bool = False, available: bool = False) -> DataFrame:
    """name, section, place, line: the lines of each PDF's batch report in the order of section and place.

    reports: as judged_sheets gives them, with base; page_number comes once in a PDF.
    """
    stem = F.regexp_replace(F.element_at(F.split("pdf_path", "/"), -1), r"\.[^.]*$", "")
    named = reports.withColumn("name", F.concat(stem, F.lit("_"), F.col(base).cast("string"), F.lit("_batch_report.json"))).withColumn("place", F.coalesce(F.col("page_number"), F.lit(0)).cast("long"))
    verdict = F.col("compliance.is_compliant")
    of_list = F.when(verdict, 0).when(~verdict, 1).otherwise(2)
    quoted = lambda c: F.substring(F.to_json(F.array(c.cast("string"))), 2, 2**30)
    text = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    about = named.groupBy("name", "pdf_path", F.col(base).alias("_base")).agg(F.count("*").alias("n"), F.min("place").alias("_first"), *[F.min(F.when(of_list == k, F.col("place"))).alias(f"_first{k}") for k in range(3)])
    flags = f', "ollama_reachable": {str(reachable).lower()}, "text_llm_model": "{model}", "text_llm_available": {str(available).lower()}, "drawings": ['
    opened = about.withColumns({"_p": quoted(F.col("pdf_path")), "_b": quoted(F.col("_base"))}).select("name", F.lit(0).alias("section"), F.lit(-1).cast("long").alias("place"), F.concat(F.lit('{"pdf_path": '), text("_p"), F.lit(', "base_drawing_id": '), text("_b"), F.lit(', "total_drawings": '), F.col("n").cast("string"), F.lit(flags)).alias("line"))
    lists = F.array(*[F.struct(F.lit(2 * k + 2).alias("section"), F.lit(f'], "{x}": [').alias("line")) for k, x in enumerate(LISTS)], F.struct(F.lit(8).alias("section"), F.lit("]}").alias("line")))
    closed = about.select("name", F.explode(lists).alias("_l")).select("name", "_l.section", F.lit(-1).cast("long").alias("place"), "_l.line")
    # what comes first in a list has no comma before it; the firsts are a row for each PDF
    held = named.join(about.select("name", "_first", *[f"_first{k}" for k in range(3)]), "name")
    comma = lambda first: F.when(F.col("place") == first, "").otherwise(",")
    first_of: Column = F.when(of_list == 0, F.col("_first0")).when(of_list == 1, F.col("_first1")).otherwise(F.col("_first2"))
    report = F.to_json(F.struct(*report_columns()), {"ignoreNullFields": "false"})
    each = held.withColumn("_id", quoted(F.col("drawing_id"))).select("name", "place", F.explode(F.array(F.struct(F.lit(1).alias("section"), F.concat(comma(F.col("_first")), report).alias("line")), F.struct((2 * of_list + 3).alias("section"), F.concat(comma(first_of), text("_id")).alias("line")))).alias("_l"))
    return opened.unionByName(closed).unionByName(each.select("name", "_l.section", "place", "_l.line"))


def write_batch_pieces(reports: DataFrame, folder: str, base: str = "base", partitions: int | None = None, **about) -> None:
    """Writes each PDF's batch report as folder/name=.../part-..., whose files are the document one after the other."""
    order = ["name", "section", "place"]
    lines = batch_lines(reports, base, **about)
    dealt = lines.repartitionByRange(partitions, *order) if partitions else lines.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("name", "line").write.partitionBy("name").mode("overwrite").text(folder)
