"""Batch reports as pieces in order."""

import json

from pyspark.sql import functions as F

from plumbline.operators import analysis, sheets
from plumbline.sources import pieces


def reports(spark, rows):
    """Sheets of PDFs whose texts decide their verdicts."""
    given = spark.createDataFrame(rows, "pdf_path string, base string, page_number int, text string").withColumn("drawing_id", sheets.sheet_id(F.col("base"), F.col("page_number")))
    blank = {c: F.lit(None).cast("string") for c in ("raw_ocr_text", "llava_caption")}
    made = given.withColumns({"total_pages": F.lit(1), "chunks": F.array().cast(sheets.CHUNKS)} | blank)
    return sheets.judged_sheets(made, {"materials": {"allowed": ["good"], "forbidden": ["bad"]}}, asked=False, more=("base",))


def documents(folder):
    """The text of each document, from its files in the order of their names."""
    return {d.name.split("=", 1)[1]: json.loads("".join(p.read_text(encoding="utf-8") for p in sorted(d.glob("part-*")))) for d in folder.iterdir() if d.is_dir()}


def test_pieces_are_the_batch_report(spark, tmp_path):
    """In many partitions; verdicts of all kinds, of one kind, and names with quotes."""
    said = ["good", "bad", "none \"of\" them\n"]
    rows = [("/x/p.pdf", "d", k, said[k % 3]) for k in range(1, 200)] + [("/x/q.pdf", 'e"1', 7, "bad")] + [("/x/r.pdf", "f", k, "good") for k in (3, 2)]
    r = reports(spark, rows)
    pieces.write_batch_pieces(r, str(tmp_path / "out"), partitions=16, model="m", reachable=True)
    got = documents(tmp_path / "out")
    wanted = {x["pdf_path"]: json.loads(x["j"]) for x in sheets.batch_reports(r, "base", "m", True).select("pdf_path", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()}
    assert len(got) == 3 and {d["pdf_path"]: d for d in got.values()} == wanted
    assert len(list((tmp_path / "out" / "name=p_d_batch_report.json").glob("part-*"))) > 4


def test_a_large_pdf(spark, tmp_path):
    """20,000 sheets of one PDF: no partition has more than a share of them."""
    n = 20_000
    sheets_of = spark.range(1, n + 1).select(F.lit("/x/big.pdf").alias("pdf_path"), F.lit("b").alias("base"), F.col("id").cast("int").alias("page_number"), F.when(F.col("id") % 2 == 0, "good").otherwise("bad").alias("text"))
    r = reports(spark, []).limit(0)
    made = sheets_of.withColumn("drawing_id", sheets.sheet_id(F.col("base"), F.col("page_number"))).withColumns({"total_pages": F.lit(n), "raw_ocr_text": F.lit(None).cast("string"), "llava_caption": F.lit(None).cast("string"), "chunks": F.array().cast(sheets.CHUNKS)})
    big = sheets.judged_sheets(made, {"materials": {"allowed": ["good"], "forbidden": ["bad"]}}, asked=False, more=("base",))
    assert big.columns == r.columns
    lines = pieces.batch_lines(big)
    dealt = lines.repartitionByRange(20, "name", "section", "place").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert dealt[1] == 2 * n + 5 and dealt[0] < 6_000
    pieces.write_batch_pieces(big, str(tmp_path / "out"), partitions=20)
    (d,) = documents(tmp_path / "out").values()
    assert [x["page_number"] for x in d["drawings"]] == list(range(1, n + 1)) and len(d["compliant"]) == len(d["non_compliant"]) == n // 2


def test_batches_of_files_without_pages(spark):
    pdfs = spark.createDataFrame([("/x/p.pdf", "d"), ("/x/none.pdf", "n")], "pdf_path string, base string")
    got = {b["pdf_path"]: b for b in sheets.batch_reports(reports(spark, [("/x/p.pdf", "d", 1, "bad")]), "base", pdfs=pdfs).collect()}
    assert got["/x/none.pdf"]["total_drawings"] == 0 and got["/x/none.pdf"]["drawings"] == [] and got["/x/none.pdf"]["base_drawing_id"] == "n"
    assert got["/x/p.pdf"]["non_compliant"] == ["d-стр.1"]


def test_names_of_how_pages_make_sheets():
    assert (analysis.DRAWING, analysis.PAGE) == ("drawing", "page")
