"""Rules as a table, placed images, appends that are repeated."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import classify
from plumbline.operators import chunk, rule_tables, rules
from plumbline.sources import files

SOME = {
    "dimensions": [
        {"field": "bolt_size", "allowed_values": ["M12x1.75", " M16x2 "], "tz_reference": "1", "standard": "A"},
        {"field": "wall", "min": 4.0, "max": 12.0, "unit": "мм", "description": "стенка"},
        {"field": "gap", "max": 3.0, "unit": "мм"},
    ],
    "materials": {"allowed": ["Ст3сп", "09Г2С"], "forbidden": ["Ст5"], "standard": "B", "tz_reference": ""},
    "designations": {"pattern": r"[А-ЯA-Z]{2,5}-\d{3,6}", "examples": ["КД-00100"], "tz_reference": "4"},
    "coatings": {"allowed_codes": ["Хим.Окс", "Ц6"], "tz_reference": "5"},
    "tolerances": {"allowed_grades": ["h6"]},
}
OTHER = {"dimensions": [{"field": "wall", "min": 1.0, "max": 2.0, "unit": "мм"}, {"field": "depth", "allowed_values": ["7 мм"], "min": 1.0}], "materials": {"forbidden": ["Ст3сп"]}}
FIELDS = ("item_id", "name", "size", "material", "designation", "note")
ELEMENTS = [
    ("1", "Болт", "M16x2", "Ст3сп", "КД-00100", "Ц6"), ("", "Болт", "M22", "Ст5", "кд-1", "Ц9"), (None, None, "8 мм", "Ст4", None, "Ц9, Ц60"), ("2", None, "2,5 мм", None, "", None),
    ("3", "", "15.0", " 09Г2С ", "АБ-123456789", "Хим.Окс"), ("4", "x", "M8", "", "xx", "Ан.Окс"), ("5", "x", "7 мм", "Ст3сп", None, ""), ("6", "x", None, None, None, None), ("7", "x", "без числа", "Ст5", "АБ-1234", "Кд12"),
]


def folder(tmp_path):
    for name, given in (("some", SOME), ("other", OTHER), ("empty", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(given, ensure_ascii=False, indent=1), encoding="utf-8")
    return str(tmp_path)


def test_two_specifications_in_one_job(spark, tmp_path):
    """Each element is judged as the rules of its file would have it by themselves."""
    table = rule_tables.read_rules(spark, folder(tmp_path))
    specs = {"some": SOME, "other": OTHER, "empty": {}, "none": {}}
    rows = [(spec, k, *e) for spec in specs for k, e in enumerate(ELEMENTS)]
    schema = "spec string, k int, " + ", ".join(f"{f} string" for f in FIELDS)
    got = {(r["spec"], r["k"]): r for r in rule_tables.element_findings(spark.createDataFrame(rows, schema), table).collect()}
    assert len(got) == len(rows)
    for spec, given in specs.items():
        alone = spark.createDataFrame([(k, *e) for k, e in enumerate(ELEMENTS)], "k int, " + ", ".join(f"{f} string" for f in FIELDS))
        for r in rules.element_findings(alone, given).collect():
            assert got[spec, r["k"]]["issues"] == r["issues"], (spec, r)
            assert got[spec, r["k"]]["missing"] == r["missing"], (spec, r)


def test_sentences_are_those_of_a_rules_file(spark, tmp_path):
    got = {r["spec"]: r["text"] for r in rule_tables.sentences(rule_tables.read_rules(spark, folder(tmp_path))).collect()}
    assert got == {"some": chunk.rules_text(SOME), "other": chunk.rules_text(OTHER), "empty": chunk.rules_text({})}


def test_a_field_that_comes_again(spark):
    """The last rule counts, in the place of the first."""
    kinds = "spec string, ord int, field string, description string, allowed_values array<string>, min double, max double, unit string, standard string, tz_reference string"
    rows = [("a", 1, "x", None, None, 1.0, 2.0, "", "", ""), ("a", 2, "y", None, None, 1.0, 9.0, "", "", ""), ("a", 3, "x", None, None, 5.0, 6.0, "", "", "")]
    others = spark.createDataFrame([("a",), ("b",)], "spec string").select("spec", *[F.lit(None).cast(k).alias(n) for n, k in (("materials", "struct<allowed:array<string>,forbidden:array<string>,standard:string,tz_reference:string>"), ("designations", "struct<pattern:string,examples:array<string>,tz_reference:string>"), ("coatings", "struct<allowed_codes:array<string>,standard:string,tz_reference:string>"))])
    got = {r["spec"]: r["dimensions"] for r in rule_tables.by_specification(spark.createDataFrame(rows, kinds), others).collect()}
    assert [(d["field"], d["min"]) for d in got["a"]] == [("x", 5.0), ("y", 1.0)] and got["b"] == []


def test_images_that_are_clipped(spark):
    """Inside, over an edge, beside the page, without a rectangle; twice the same image; a page of no size."""
    page = (0.0, 0.0, 10.0, 10.0)
    rows = [(1, 7, 1.0, 1.0, 3.0, 3.0, *page), (1, 7, 8.0, 8.0, 12.0, 9.0, *page), (1, 8, 20.0, 0.0, 30.0, 10.0, *page), (1, 9, None, None, None, None, *page), (2, 7, 0.0, 0.0, 50.0, 50.0, *page), (3, 7, 0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 5.0, 9.0)]
    kinds = "page_number int, xref int, left double, top double, right double, bottom double, page_left double, page_top double, page_right double, page_bottom double"
    got = {r["page_number"]: (round(r["image_area_ratio"], 9), r["image_count"]) for r in classify.placed_metrics(spark.createDataFrame(rows, kinds).withColumn("doc_id", F.lit("d"))).collect()}
    assert got == {1: (0.06, 2), 2: (1.0, 1), 3: (0.0, 0)}


@pytest.mark.parametrize("times", [1, 3])
def test_an_append_that_is_repeated(spark, tmp_path, times):
    rows = spark.createDataFrame([("a", 1, 0, "x"), ("a", 1, 1, "y"), ("a", 1, 1, "y")], "drawing_id string, page_number int, chunk_id int, text string")
    for _ in range(times):
        files.append_chunks(rows, str(tmp_path / "i"))
    files.append_chunks(rows.withColumn("page_number", F.lit(2)), str(tmp_path / "i"))
    assert sorted((r["page_number"], r["chunk_id"]) for r in spark.read.parquet(str(tmp_path / "i")).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]
