import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import classify, text
from plumbline.operators import chunk, extract, replies, reports, rules, search, segment

RULES = {
    "dimensions": [{"field": "bolt_size", "allowed_values": ["M12x1.75", "M14x2", "M16x2"]}, {"field": "wall_thickness", "min": 4.0, "max": 12.0, "unit": "мм"}],
    "materials": {"allowed": ["Ст3сп", "09Г2С", "12Х18Н10Т"], "forbidden": ["Ст5", "Ст6"]},
    "designations": {"pattern": r"^[А-ЯA-Z]{2,5}-\d{3,6}(-\d{2})?$"},
    "coatings": {"allowed_codes": ["Хим.Окс", "Ц6", "Н12"]},
}
ELEMENT = "drawing_id string, pos int, item_id string, name string, size string, material string, designation string, note string"
REPORT = f"drawing_id string, heuristic boolean, is_compliant boolean, issues array<{rules.ISSUE}>, missing_info array<string>, overall_confidence string"


def each(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_first_number(spark):
    assert each(spark, ["4.5 мм", "12", "3,5", "M16x1.5", None, "", "1,234.5"], text.first_number) == [4.5, 12.0, 3.5, 16.0, None, None, 1.234]


def issues(spark, **given):
    row = {"drawing_id": "a", "pos": 0, "item_id": "Поз01", "name": "Болт", "size": None, "material": None, "designation": None, "note": None} | given
    r = rules.element_findings(spark.createDataFrame([row], ELEMENT), RULES).first()
    return [i["field"].split(" ")[0] for i in r["issues"]], len(r["missing"])


@pytest.mark.parametrize(
    ("given", "fields", "missing"),
    [
        ({"size": "M16x2"}, [], 2),
        ({"size": "M22x2.5"}, ["bolt_size"], 2),
        ({"size": "8.0 мм"}, [], 2),
        ({"size": "2.5 мм"}, ["wall_thickness"], 2),
        ({"size": "15.0 мм"}, ["wall_thickness"], 2),
        ({"size": "m16x2"}, ["wall_thickness"], 2),
        ({"material": "Ст3сп"}, [], 1),
        ({"material": "Ст4"}, ["material"], 1),
        ({"material": "Ст5"}, ["material"], 1),
        ({"designation": "КД-00100"}, [], 1),
        ({"designation": "неверное-обозначение"}, ["designation"], 1),
        ({"note": "Ц60"}, [], 2),
        ({"note": "Ц9"}, ["coating"], 2),
        ({"note": "Ц9, Ц6"}, [], 2),
    ],
)
def test_element_checks(spark, given, fields, missing):
    assert issues(spark, **given) == (fields, missing)


def judge(spark, elements, rule_set=RULES, heuristic=False, prior=None):
    reports_ = spark.createDataFrame([("a", heuristic, prior, [], [], "high")], REPORT)
    rows = [("a", i, "Поз01", "Болт", *e, None) for i, e in enumerate(elements)]
    return rules.validated(reports_, spark.createDataFrame(rows, ELEMENT), rule_set).first()


def test_verdict_table(spark):
    good, bad = ("M16x2", "Ст3сп", "КД-00100"), ("M22x2.5", "Ст3сп", "КД-00100")
    assert [judge(spark, [good], heuristic=h, prior=p)["is_compliant"] for h in (False, True) for p in (None, True, False)] == [True, True, True, True, True, False]
    assert judge(spark, [bad], prior=True)["is_compliant"] is False
    r = judge(spark, [])
    assert r["is_compliant"] is None and "не извлечены" in r["missing_info"][0]
    assert "не найдены" in judge(spark, [], heuristic=True)["missing_info"][0]
    r = judge(spark, [bad], rule_set={})
    assert r["is_compliant"] is None and "пустой" in r["missing_info"][0] and not r["issues"] and r["overall_confidence"] == "high"
    assert judge(spark, [good], prior=True)["overall_confidence"] == "high"


@pytest.mark.parametrize(
    ("said", "ratio", "images", "flag"),
    [
        ("Чертёж № 3-4. План этажа", 0.0, 0, "is_drawing"),
        ("Экспликация помещений. Площадь квартиры.", 0.0, 0, "is_explication"),
        ("Примечания. Масштаб 1:100. Условные обозначения. Размеры 1200 x 800", 0.0, 0, "is_annotation"),
        ("неразмеченный текст " * 8, 0.0, 0, None),
        ("x", 0.0, 0, None),
        ("реклама", 0.0, 0, "is_irrelevant_photo_or_ad"),
        ("АВТОР", 0.0, 0, "is_irrelevant_photo_or_ad"),
        ("", 0.5, 2, "is_irrelevant_photo_or_ad"),
        ("План этажа. реклама скидки", 0.5, 1, "is_irrelevant_photo_or_ad"),
        ("План этажа. Примечания и масштаб 1:50", 0.0, 0, "is_drawing"),
    ],
)
def test_page_classes(spark, said, ratio, images, flag):
    page = spark.createDataFrame([(said, ratio, images)], "pdf_text string, image_area_ratio double, image_count int")
    r = classify.classified(classify.features(page)).first()
    assert [f for f in classify.FLAGS if r[f]] == ([flag] if flag else [])


KINDS = {"D": "is_drawing", "E": "is_explication", "A": "is_annotation", "P": "is_project_info", "X": "is_irrelevant_photo_or_ad"}


def album(spark, kinds, new=()):
    rows = [("a", i + 1, *[k == x for x in KINDS], i in new, "n", None) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "doc_id string, page_number int, " + ", ".join(f"{c} boolean" for c in KINDS.values()) + ", begins_new_project boolean, label string, signature string")


@pytest.mark.parametrize(
    ("kinds", "new", "most", "counts"),
    [
        ("DXD", (), 48, [1, 1]),
        ("ED", (), 48, [2]),
        ("AA", (), 48, []),
        ("D" * 12, (), 10, [10, 2]),
        ("DDD", (), 48, [3]),
        ("P-D", (), 48, [3]),
        ("DDD", (1,), 48, [1, 2]),
        ("D---D", (), 48, [5]),
        ("D----D", (), 48, [1, 1]),
        ("--D--", (), 48, [5]),
        ("---D---", (), 48, [1]),
    ],
)
def test_drawing_files(spark, kinds, new, most, counts):
    got = segment.drawing_files(album(spark, kinds, new), most).orderBy("seq").collect()
    assert [r["n_pages"] for r in got] == counts
    if new:
        assert [r["stem"][:12] for r in got] == ["drawing_p01_", "drawing_p02_"]
    with pytest.raises(ValueError):
        segment.drawing_files(album(spark, kinds), 0)


@pytest.mark.parametrize(("signs", "stems"), [(["A", None, "A"], ["A"]), (["A", "B", "A"], ["A", "B", "A_2"]), ([None, "A"], ["A"]), ([None, None], [])])
def test_project_boundaries(spark, signs, stems):
    pages = spark.createDataFrame([("a", i + 1, s) for i, s in enumerate(signs)], "doc_id string, page_number int, signature string")
    found = segment.with_stems(segment.project_boundaries(pages).withColumn("slug", F.col("signature")), "slug").orderBy("start_page").collect()
    assert [r["stem"] for r in found] == stems
    if found:
        assert found[-1]["end_page"] == len(signs)


def test_needs_ocr(spark):
    title = "Двухэтажный жилой дом из кирпича с гаражом " * 4
    assert each(spark, ["", "мало", "x" * 99, "a�" * 80, "latin only text " * 10, title], text.needs_ocr) == [True, True, True, True, True, False]


def test_threads_in_texts(spark):
    given = spark.createDataFrame([("a", "M14x2.5"), ("b", "болт m16x2мм, M12x1,75; Ст5сп"), ("c", None)], "drawing_id string, text string")
    found = extract.extracted(given, RULES).orderBy("drawing_id", "pos").collect()
    assert [r["size"] for r in found if r["drawing_id"] == "a"] == ["M14x2", "M14x2.5"]
    assert [r["size"] or r["material"] for r in found if r["drawing_id"] == "b"] == ["M16x2", "M12x1,75", "Ст5"]
    assert extract.extracted(given, {}).count() == 0


def test_replies(spark):
    def reply(**about):
        return json.dumps({"elements": [{"size": "M8", "confidence": "odd", "source": "x"}, {"size": 5}], "compliance": about})

    raws = ["```json\n" + reply(is_compliant="FALSE", missing_info=[{"field": "y", "text": "z"}, 123], citations=[{"text": "t"}]) + "\n```", "no json", "{broken}", reply(is_compliant="maybe", missing_info="one", citations=None)]
    got = replies.parsed(spark.createDataFrame(list(enumerate(raws)), "drawing_id int, raw string")).orderBy("drawing_id").collect()
    assert [r["is_compliant"] for r in got] == [False, None, None, None]
    assert [len(r["elements"]) for r in got] == [1, 0, 0, 1]
    assert got[0]["elements"][0]["confidence"] == "medium" and got[0]["elements"][0]["source"] == "pdf_text"
    assert got[0]["missing_info"] == ["y", "123"] and got[0]["citations"] == ["t"] and got[3]["missing_info"] == ["one"]
    assert got[1]["missing_info"] == [replies.NO_JSON] and got[2]["missing_info"] == [replies.BAD_JSON] and got[1]["overall_confidence"] == "low"


def test_chunks(spark):
    long = "Слово слово. " * 60
    given = ["", "  \n\n ", "a b", "a" * 300 + "\n\n" + "b" * 300, long, "x\n\n" + long.replace(". ", " "), "y" * 700]
    got = each(spark, given, chunk.chunks_of)
    assert got[:3] == [[], [], ["a b"]]
    assert got[3] == ["a" * 300, "a" * 100 + "\n\n" + "b" * 300]
    assert len(got[4]) == 2 and all(len(c) <= 500 for c in got[4])
    assert len(got[5]) == 2 and len(got[5][1]) > 500
    assert got[6] == ["y" * 700]


def test_ocr_choice(spark):
    pages = spark.createDataFrame([(0, "a" * 60, "b" * 90), (1, "a" * 10, "b" * 30), (2, "a" * 30, "b" * 30), (3, None, None)], "i int, tess_text string, easy_text string")
    assert [(r["engine"], r["confidence"]) for r in reports.best_ocr(pages).orderBy("i").collect()] == [("tesseract", "medium"), ("easyocr", "low"), ("tesseract", "low"), ("none", "low")]


def test_search_keeps_all_where_there_are_few(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id int, embedding array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [r["id"] for r in search.search(chunks, queries, 5).orderBy("rank").collect()] == [1, 2, 3]


def test_bucket_sizes_gather_the_first_ids_alone(spark):
    rows = [("a", i, True) for i in range(30)] + [("a", 99, False), ("b", 5, None), (None, 7, True), (None, 3, True)]
    d = spark.createDataFrame(rows, "source string, drawing_id long, is_compliant boolean")
    got = {r["source"]: tuple(r)[1:] for r in reports.bucket_sizes(d, "source", "drawing_id", 8).collect()}
    assert got == {"a": (31, 30, 1, 0, list(range(8))), "b": (1, 0, 0, 1, []), None: (2, 2, 0, 0, [3, 7])}
