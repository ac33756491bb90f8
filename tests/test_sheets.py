"""Sheets, sources, search and streaming on small inline rows."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import classify, text
from plumbline.operators import chunk, extract, replies, reports, rules, search, sheets
from plumbline.sources import files, named, services
from plumbline.streaming import pages as stream

#: A report as a reader of another program would have it.
SAMPLE = {
    "drawing_id": "D-1", "pdf_path": "a.pdf", "page_number": None, "total_pages": 1, "llm_used": True,
    "elements": [{"item_id": "1", "name": "n", "element_type": None, "size": "M16x2", "material": "Ст3сп", "designation": "КД-00100", "note": None, "source": "pdf_text", "confidence": "medium", "raw_text_fragment": None}],
    "compliance": {"standard": "S", "is_compliant": True, "issues": [], "missing_info": [], "citations": ["c"]},
    "raw_ocr_text": None, "llava_caption": None, "tz_chunks_used": [], "overall_confidence": "high",
}
RULES = {"dimensions": [{"field": "bolt_size", "allowed_values": ["M16x2", "M8"]}], "materials": {"allowed": ["Ст3сп"], "forbidden": ["Ст0"], "tz_reference": "2"}}


def made(spark):
    pages = spark.createDataFrame([("a", 1, "Болт M16x2, Ст0", "read", None, "[ОШИБКА] x"), ("a", 2, None, None, None, "seen"), ("b", 1, " ", None, None, None)], "drawing_id string, page_number int, pdf_text string, ocr_text string, ocr_engine string, caption string")
    return reports.fused(pages, "drawing_id").withColumns({"pdf_path": F.concat("drawing_id", F.lit(".pdf")), "page_number": F.lit(None).cast("int"), "total_pages": F.lit(2)})


def hits(spark):
    return spark.createDataFrame([("a", 1, "x#1", "x", "chunk one", 0.9), ("a", 2, "x#2", "x", "chunk two", 0.5)], "query_id string, rank int, id string, source string, text string, score double")


def test_fused_texts_with_and_without_engines(spark):
    got = {r["drawing_id"]: r for r in made(spark).collect()}
    assert got["a"]["text"] == "[PDF стр.1]\nБолт M16x2, Ст0\n\n[OCR стр.1 (tesseract)]\nread\n\n[LLaVA стр.2]\nseen"
    assert (got["a"]["raw_ocr_text"], got["a"]["llava_caption"]) == ("[OCR стр.1 (tesseract)]\nread", "[LLaVA стр.2]\nseen")
    assert (got["b"]["text"], got["b"]["raw_ocr_text"]) == ("", None)


def test_reports_of_sheets_and_their_json(spark, tmp_path):
    raw = spark.createDataFrame([("a", '{"elements": [], "compliance": {"is_compliant": true}}'), ("b", None)], "drawing_id string, raw string")
    r = sheets.sheet_reports(made(spark), hits(spark), raw, RULES)
    got = {x["drawing_id"]: x for x in r.collect()}
    a, b = got["a"], got["b"]
    assert [e["size"] or e["material"] for e in a["elements"]] == ["M16x2", "Ст0"] and a["compliance"]["is_compliant"] is False
    assert a["tz_chunks_used"] == ["chunk one", "chunk two"] and a["llm_used"] and a["pdf_path"] == "a.pdf"
    assert not b["llm_used"] and b["elements"] == [] and b["tz_chunks_used"] == [] and "недоступна" in b["compliance"]["missing_info"][0] and b["compliance"]["is_compliant"] is None
    assert {x["drawing_id"]: x["summary"] for x in sheets.summary(r).collect()}["a"] == "Чертёж a: НЕ СООТВЕТСТВУЕТ | Элементов: 2 | Расхождений: 1 | Не определено: 1"
    files.write_json(r, str(tmp_path / "r"))
    read = {x["drawing_id"]: x.asDict(True) for x in spark.read.schema(files.REPORT).json(str(tmp_path / "r")).collect()}
    assert read == {k: v.asDict(True) for k, v in got.items()}
    batch = sheets.batch_reports(r.withColumn("base", F.lit("p")).withColumn("pdf_path", F.lit("p.pdf")), "base").first()
    assert batch["total_drawings"] == 2 and batch["non_compliant"] == ["a"] and batch["undetermined"] == ["b"] and len(batch["drawings"]) == 2
    stub = {x["drawing_id"]: x for x in sheets.sheet_reports(made(spark), hits(spark), None, RULES, "m").collect()}
    assert "«m»" in stub["b"]["compliance"]["missing_info"][0] and not stub["a"]["llm_used"] and len(stub["a"]["elements"]) == 2


def test_album_keeps_projects_that_have_a_file(spark):
    r = sheets.sheet_reports(made(spark), hits(spark), None, RULES)
    bounds = spark.createDataFrame([("album", 1, 3, "a"), ("album", 4, 9, "b"), ("none", 1, 2, "c")], "doc_id string, start_page int, end_page int, stem string")
    listing = spark.createDataFrame([("/p/a.pdf",), ("/p/z.pdf",)], "path string")
    got = {x["source_album"]: x for x in sheets.album_reports(bounds, listing, r, "/p").collect()}
    assert [p["drawing_id"] for p in got["album"]["projects"]] == ["a"] and got["album"]["projects"][0]["album_pages"]["end"] == 3
    assert len(got["album"]["split_boundaries"]) == 2 and got["none"]["projects"] == [] and got["album"]["pipeline_report_path"] == "/p/album_pipeline_report.json"


def test_a_report_file_is_read_and_judged(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(SAMPLE, indent=2), encoding="utf-8")
    r = files.reports(spark, str(tmp_path / "r.json"))
    assert r.first().asDict(True) == SAMPLE
    elements = r.select("drawing_id", F.posexplode("elements").alias("pos", "e")).select("drawing_id", "pos", "e.*")
    flat = r.select("drawing_id", F.lit(False).alias("heuristic"), "compliance.is_compliant", "compliance.issues", "compliance.missing_info", "overall_confidence")
    judged = rules.validated(flat, elements, RULES).first()
    assert judged["is_compliant"] is True and judged["issues"] == []


def test_index_has_specification_and_rules(spark):
    spec = spark.createDataFrame([("spec.md", "Первое.\n\nВторое.")], "source string, text string")
    many = RULES | {"dimensions": [{"field": f"f{i}", "min": 1.0, "max": 2.0, "unit": "мм"} for i in range(20)]}
    got = sheets.index_chunks(spec, many).orderBy("id").collect()
    assert [r["source"] for r in got] == ["rules.json", "rules.json", "spec.md"]
    assert got[0]["text"] == "=== Машиночитаемые правила ТЗ ===" and got[1]["text"].startswith(got[0]["text"] + "\n\nПоле 'f0'") and len(got[1]["text"]) > 500
    assert chunk.rules_text(many).count("\n") == 22
    with pytest.raises(ValueError):
        sheets.index_chunks(spec.limit(0), {})
    with_texts = sheets.hits_with_texts(spark.createDataFrame([("q", 1, got[2]["id"], 0.5)], "query_id string, rank int, id string, score double"), sheets.index_chunks(spec, many))
    assert with_texts.first()["text"] == "Первое.\n\nВторое."


def test_prompts(spark):
    p = {r["drawing_id"]: r["prompt"] for r in sheets.prompts(made(spark), hits(spark)).collect()}
    assert "[1] Источник: x (релевантность: 0.90)\nchunk one\n\n---\n\n[2]" in p["a"] and reports.NO_CHUNKS in p["b"] and "Чертёж a:" in p["a"]
    long = made(spark).withColumn("text", F.repeat(F.lit("я"), 5000))
    assert sheets.prompts(long, hits(spark), "{text}").first()["prompt"] == "я" * 3000


@pytest.mark.parametrize("values", [4, 1000])
def test_search_in_blocks_is_exact(spark, values):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(60)] + [(99, None)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)
    queries = chunks.where("id % 20 = 0 or id = 99").withColumnRenamed("id", "query_id")
    got = {}
    for r in search.search(chunks, queries, 4, leave_self=True, block_values=values).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    of = dict(rows)
    for q in (0, 20, 40):
        best = sorted((-(of[q][0] * v[0] + of[q][1] * v[1]), i) for i, v in rows if v and i != q)[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == [(i, -s) for s, i in best]
    assert 99 not in got


def test_odd_replies(spark):
    def listed(**about):
        return json.dumps({"elements": [], "compliance": about})

    raws = [listed(missing_info={"field": "y"}, citations=[1.0, 2, 1.5, True, None]), listed(issues=[{"field": None, "message": "m"}, {"field": "f", "message": None}, {"message": "kept"}, {"field": "g", "message": "h", "expected": None}])]
    got = replies.parsed(spark.createDataFrame(list(enumerate(raws)), "drawing_id int, raw string")).orderBy("drawing_id").collect()
    assert json.loads(got[0]["missing_info"][0]) == {"field": "y"} and got[0]["citations"] == ["1.0", "2", "1.5", "True", "None"]
    assert [(i["field"], i["message"]) for i in got[1]["issues"]] == [("unknown", "kept"), ("g", "h")]


def test_threads_of_the_first_rule_alone(spark):
    given = {"dimensions": [{"field": "bolt_size", "allowed_values": ["M8", "M10", "m8"]}, {"field": "bolt_size", "allowed_values": ["X9"]}]}
    found = extract.extracted(spark.createDataFrame([("a", "m10 и M8, X9")], "drawing_id string, text string"), given).orderBy("pos").collect()
    assert [r["size"] for r in found] == ["M8", "M10"]


def test_rules_and_specifications(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{broken")
    (tmp_path / "good.json").write_text(json.dumps(RULES, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "spec.md").write_text("Один.\n\nДва.", encoding="utf-8")
    assert files.load_rules(spark, str(tmp_path / "none.json")) == {} == files.load_rules(spark, str(tmp_path / "bad.json"))
    assert files.load_rules(spark, str(tmp_path / "good.json")) == RULES
    assert tuple(files.specification(spark, str(tmp_path / "spec.md")).first()) == ("spec.md", "Один.\n\nДва.")


def test_listing_pages_images_and_cut_files(spark, tmp_path):
    for n in ("drawing_b.pdf", "drawing_a.pdf", "other.pdf"):
        (tmp_path / n).write_bytes(n.encode())
    found = files.drawing_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[-1] for r in found.collect()] == ["drawing_a.pdf", "drawing_b.pdf"]
    with pytest.raises(NotADirectoryError):
        files.drawing_files(spark, str(tmp_path / "other.pdf"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.pdf_files(spark, str(tmp_path / "none")).count()
    reader = lambda path, content: iter([{"page_number": k, "pdf_text": content.decode() * k * 2, "image": content, "has_drawings": k == 1} for k in (1, 2)])
    pages = files.pages(found, reader)
    assert pages.count() == 4 and pages.where("has_drawings").count() == 2
    images = files.page_images(pages, "doc_id", render_all=False)
    assert {r["name"] for r in images.collect()} == {"drawing_a_page_001.png", "drawing_b_page_001.png"}
    named.write_files(images, str(tmp_path / "out"))
    assert (tmp_path / "out" / "drawing_a_page_001.png").read_bytes() == b"drawing_a.pdf"
    named.write_files(images, str(tmp_path / "out"), overwrite=False)
    assert len(list((tmp_path / "out").glob("drawing_*_1.png"))) == 2
    albums = found.select(F.lit("x").alias("doc_id"), "content").limit(1)
    cut = files.cut_files(albums, spark.createDataFrame([("x", "s", [3, 4])], "doc_id string, stem string, pages array<int>"), lambda content, numbers: content[: len(numbers)])
    assert tuple(cut.first()) == ("s.pdf", bytearray(b"dr"))


def test_plug_ins(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a" * 60)), (2, bytearray(b"bb")), (3, None), (4, bytearray(b"\xff"))], "page_number int, image binary")
    got = {r["page_number"]: r for r in files.read_by_two(rows, lambda: lambda c: c.decode(), lambda: lambda c: "second " * 20).collect()}
    assert (got[1]["tess_text"], got[1]["easy_text"]) == ("a" * 60, None) and got[2]["easy_text"].startswith("second") and (got[3]["easy_text"], got[4]["tess_text"]) == ("", "")
    picked = {r["page_number"]: r["engine"] for r in reports.best_ocr(spark.createDataFrame(list(got.values()))).collect()}
    assert picked == {1: "tesseract", 2: "easyocr", 3: "none", 4: "easyocr"}
    texts = spark.createDataFrame([("a",), ("bcd",)], "text string")
    assert {tuple(r["embedding"]) for r in files.embedded(texts, lambda: lambda some: [[float(len(t))] for t in some]).collect()} == {(1.0,), (3.0,)}
    assert {r["said"] for r in services.asked(texts, lambda: str.upper, "text", "said").collect()} == {"A", "BCD"}


def test_plug_ins_have_slices_of_large_batches(spark):
    """A task does not hold what an engine reads of all that Spark hands it at once; each engine has each image once."""
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in (0, 5, 70, 10, 10, 10, 30)] * 40)], names=["image"])
    parts = list(files.slices(iter([batch, batch.slice(0, 0)]), 100))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and all(p.nbytes <= 100 or p.num_rows == 1 for p in parts) and len(parts) < 280
    calls = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def engine(k, said):
        def read(content):
            calls[k].add(1)
            return said(content.decode())

        return lambda: read

    rows = spark.range(0, 200, 1, 2).select("id", F.expr("encode(repeat(if(id % 4 = 0, 'ab', '-1'), 30), 'UTF-8')").alias("image"))
    got = files.read_by_two(rows, engine(0, lambda t: t.replace("-1", "-")), engine(1, lambda t: "Ёё" + t)).collect()
    assert [c.value for c in calls] == [200, 150] and len(got) == 200
    assert all((r["easy_text"] is None) == (r["id"] % 4 == 0) for r in got)


def test_meaningful_chars_are_counted(spark):
    said = ["", "a b", "ёЁяЯ-№9", "😀é日x", "\n\t", None]
    assert [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string").orderBy("k").select(text.meaningful_chars(F.col("t"))).collect()] == [0, 2, 5, 1, 0, None]


def test_labels_are_computed_once(spark):
    """Each pattern stands once in the plan, however many cases its result goes through; no text is collapsed twice."""
    said = ["", " \n", "Чертёж № 12 / a", "x план этажа  3\n", "см. 7 - AB1 тут", "a1-B2", "a 12-B2", "..__", "w " * 60, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string")
    made = df.select("k", text.sheet_label(F.col("t")).alias("label"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 3 and plan.count("regexp_replace(t#") == 1
    wanted = ["drawing", "drawing", "12___a", "план_этажа_3", "7-AB1", "a1-B2", "12-B2", "drawing", ("w_" * 32).rstrip("_"), "drawing"]
    assert [r["label"] for r in made.orderBy("k").collect()] == wanted


def test_a_missing_index_has_no_chunks(spark, tmp_path):
    schema = "id string, text string"
    assert files.chunk_index(spark, str(tmp_path / "none"), schema).count() == 0
    rows = spark.createDataFrame([("a", "b")], schema)
    files.write_chunks(rows, str(tmp_path / "i"))
    files.write_chunks(rows, str(tmp_path / "i"), append=True)
    assert files.chunk_index(spark, str(tmp_path / "i"), schema).count() == 2


def test_what_a_drawing_adds_to_its_index(spark):
    rows = spark.createDataFrame([("a", "Первое.\n\n" + "Второе. " * 90, None), ("b", " \n", 3), ("c", "x", 3)], "drawing_id string, text string, page_number int")
    got = [tuple(r)[:3] for r in sheets.drawing_chunks(rows).orderBy("drawing_id", "chunk_id").collect()]
    assert got == [("a", 1, 0), ("a", 1, 1), ("c", 3, 0)]


@pytest.mark.parametrize(
    ("page", "signature", "slug"),
    [
        ("Альбом\nЖИЛОЙ ДОМ (9,5 х 12.0) кирпич\nлист 1", "ЖИЛОЙ ДОМ (9,5 х 12.0) кирпич", "project_zhdom_9_5x12_0_kirpich"),
        ("Жилой  дом из бруса 8x10 м", "Жилой дом из бруса 8x10 м", "project_zhdom_8x10_brus"),
        ("Двухэтажный жилой дом с гаражом 10 × 12 (стены: арболит)", "Двухэтажный жилой дом с гаражом 10 × 12 (стены: арболит)", "project_2etaj_10x12_arbolit"),
        ("мансардный жилой дом без размеров", None, None),
        ("план этажа", None, None),
    ],
)
def test_project_titles(spark, page, signature, slug):
    said = text.project_signature(F.col("t"))
    got = spark.createDataFrame([(page,)], "t string").select(said.alias("s"), F.when(said.isNotNull(), text.project_slug(said)).alias("n")).first()
    assert tuple(got) == (signature, slug)


def test_small_columns(spark):
    row = spark.createDataFrame([("Заказчик: x", "пояснительная записка", [(100.0, 100.0)], 6)], "a string, b string, rects array<struct<width:double,height:double>>, paths int").select(
        classify.project_score(F.lower("a")), classify.project_score(F.lower("b")), classify.project_score(F.lit("x")), classify.has_graphics(F.col("rects"), F.lit(0)), classify.has_graphics(F.array().cast("array<struct<width:double,height:double>>"), F.col("paths")), text.base64_line(F.lit(b"x" * 100))
    ).first()
    assert list(row)[:5] == [0.82, 0.44, 0.0, True, True] and "\n" not in row[5]


def test_stream_of_pages(spark, tmp_path):
    schema = "doc_id string, page_number int, pdf_text string, image_area_ratio double, image_count int"
    spark.createDataFrame([("a", 1, "Чертёж № 3", 0.0, 0), ("a", 2, "реклама", 0.0, 0)], schema).write.parquet(str(tmp_path / "in"))
    stream.classify_stream(stream.page_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r["page_number"], r["is_drawing"], r["is_irrelevant_photo_or_ad"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, True, False), (2, False, True)}
