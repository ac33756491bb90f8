"""Names, sinks, page source, service calls and stages."""

import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import analysis, names, segment, sheets
from plumbline.sources import named, paged, services
from plumbline.sources.shared import Stages

RULES = {"dimensions": [{"field": "bolt_size", "allowed_values": ["M16x2", "M8"]}], "materials": {"allowed": ["Ст3сп"], "forbidden": ["Ст0"], "tz_reference": "2"}}


def one_by_one(stems, taken):
    """What a loop gives that takes the first name that is not there."""
    there, out = set(taken), []
    for s in stems:
        name = next(n for k in itertools.count() if (n := f"{s}_{k}" if k else s) not in there)
        there.add(name)
        out.append(name)
    return out


CASES = [(["x", "x", "x_1"], []), (["x", "x_1", "x", "x"], ["x", "x_2"]), (["x_1", "x", "x", "x_1", "x_1_1", "x"], ["x_3"]), (["a"] * 6, ["a", "a_1", "a_4"])]
CASES += [([random.Random(s).choice(["x", "x_1", "x_2", "x_1_1", "y"]) for _ in range(14)], random.Random(s).sample(["x", "x_1", "x_3", "y_2", "x_1_2"], 2)) for s in range(3)]


def test_names_are_those_of_a_loop(spark):
    """All cases in one table, each a folder of its own."""
    rows = [(c, k, s) for c, (stems, _) in enumerate(CASES) for k, s in enumerate(stems)]
    files = spark.createDataFrame(rows, "folder int, k int, stem string").repartition(4)
    taken = spark.createDataFrame([(c, t) for c, (_, ts) in enumerate(CASES) for t in ts], "folder int, name string")
    got = {(r["folder"], r["k"]): r["stem"] for r in names.free_names(files, "stem", "k", taken, ("folder",)).collect()}
    for c, (stems, there) in enumerate(CASES):
        assert [got[c, k] for k in range(len(stems))] == one_by_one(stems, there)


def test_stems_of_drawings_do_not_clash(spark):
    """Three drawings that are called x, x and x_1, in one part of an album."""
    flags = "is_explication boolean, is_annotation boolean, is_project_info boolean"
    pages = [("a", k, k % 2 == 0, k % 2 == 1, label, False, False, False, False) for k, label in enumerate(["x", "-", "x", "-", "x_1"])]
    df = spark.createDataFrame(pages, f"doc_id string, page_number int, is_drawing boolean, is_irrelevant_photo_or_ad boolean, label string, begins_new_project boolean, {flags}")
    found = {r["seq"]: r["stem"] for r in segment.drawing_files(df).collect()}
    assert [found[k] for k in (1, 2, 3)] == one_by_one(["drawing_p01_x", "drawing_p01_x", "drawing_p01_x_1"], [])
    there = spark.createDataFrame([("a", "drawing_p01_x")], "doc_id string, name string")
    found = {r["seq"]: r["stem"] for r in segment.drawing_files(df, taken=there).collect()}
    assert [found[k] for k in (1, 2, 3)] == one_by_one(["drawing_p01_x", "drawing_p01_x", "drawing_p01_x_1"], ["drawing_p01_x"])


def left(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if not p.name.startswith(".") and p.is_file())


def test_rows_of_one_name_lose_nothing(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([("a.pdf", bytearray(b"1")), ("a.pdf", bytearray(b"2")), ("a_1.pdf", bytearray(b"3")), ("a.png", bytearray(b"4"))], "name string, content binary").repartition(4)
    named.write_files(rows, str(out), overwrite=False)
    assert left(out) == ["a.pdf", "a.png", "a_1.pdf", "a_1_1.pdf"] and {(out / n).read_bytes() for n in left(out)} == {b"1", b"2", b"3", b"4"}
    named.write_files(rows.where("content = X'31'"), str(out), overwrite=False)
    assert (out / "a_2.pdf").read_bytes() == b"1" and len(left(out)) == 5
    named.write_files(rows.withColumn("k", F.hex("content").cast("int")), str(out), order="k")
    assert (out / "a.pdf").read_bytes() == b"2" and len(left(out)) == 5


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    fine = spark.createDataFrame([("a.txt", bytearray(b"old"))], "name string, content binary")
    named.write_files(fine, str(tmp_path / "out"))
    bad = F.when(F.col("id") == 7, F.raise_error(F.lit("no")).cast("string")).otherwise(F.concat(F.lit("f"), F.col("id").cast("string")))
    with pytest.raises(Exception):  # noqa: B017
        named._save(spark.range(0, 8, 1, 4).select(bad.alias("name"), F.lit(b"x").alias("content")), str(tmp_path / "out"))
    assert left(tmp_path / "out") == ["a.txt"] and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_attempts")]


def pages(spark):
    rows = [("/x/p.pdf", "d", 1, "Болт M16x2"), ("/x/p.pdf", "d", 2, "лист Ст0"), ("/x/q.pdf", "d", 1, "Ст3сп и M8")]
    return spark.createDataFrame(rows, "pdf_path string, drawing_id string, page_number int, pdf_text string").withColumns({"ocr_text": F.lit(None).cast("string"), "ocr_engine": F.lit(None).cast("string"), "caption": F.lit(None).cast("string")})


def spec(spark):
    return spark.createDataFrame([("s.md", "Болты.\n\nСтали.")], "source string, text string")


def embed(rows):
    return rows.withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(1.0)))


def test_drawings_of_one_name_in_two_files(spark, tmp_path):
    """Each has a report with its own elements; the files are named as the reports are, and can be read again."""
    r = analysis.analyze(pages(spark), spec(spark), RULES, embed)
    got = {x["pdf_path"]: x for x in r.collect()}
    assert len(got) == 2 == r.count()
    assert [e["size"] or e["material"] for e in got["/x/p.pdf"]["elements"]] == ["M16x2", "Ст0"] and got["/x/p.pdf"]["total_pages"] == 2
    assert [e["size"] or e["material"] for e in got["/x/q.pdf"]["elements"]] == ["M8", "Ст3сп"] and got["/x/q.pdf"]["compliance"]["is_compliant"] is True
    assert got["/x/p.pdf"]["tz_chunks_used"] and got["/x/p.pdf"]["page_number"] is None
    named.write_reports(r, str(tmp_path / "r"))
    assert left(tmp_path / "r") == ["p_d_report.json", "q_d_report.json"]
    text = (tmp_path / "r" / "p_d_report.json").read_text(encoding="utf-8")
    assert text.startswith('{\n  "drawing_id": "d",\n') and "Ст0" in text and json.loads(text)["page_number"] is None
    from plumbline.sources import files

    back = {x["pdf_path"]: x.asDict(True) for x in files.reports(spark, str(tmp_path / "r")).collect()}
    assert back == {k: {c: v for c, v in x.asDict(True).items() if c != "base"} for k, x in got.items()}


def test_pages_as_drawings_and_their_batch(spark, tmp_path):
    r = analysis.analyze(pages(spark), spec(spark), RULES, embed, by=analysis.PAGE)
    got = {(x["pdf_path"], x["page_number"]): x for x in r.collect()}
    assert got["/x/p.pdf", 2]["drawing_id"] == "d-стр.2" and got["/x/p.pdf", 2]["total_pages"] == 2 and got["/x/q.pdf", 1]["total_pages"] == 1
    b = sheets.batch_reports(r, "base")
    named.write_batches(b, str(tmp_path / "b"))
    assert left(tmp_path / "b") == ["p_d_batch_report.json", "q_d_batch_report.json"]
    made = json.loads((tmp_path / "b" / "p_d_batch_report.json").read_text(encoding="utf-8"))
    assert [d["drawing_id"] for d in made["drawings"]] == ["d-стр.1", "d-стр.2"] and made["non_compliant"] == ["d-стр.2"]
    with pytest.raises(ValueError):
        analysis.analyze(pages(spark), spec(spark), RULES, embed, by="book")


def test_albums_from_titles_to_files(spark, tmp_path):
    title = "ЖИЛОЙ ДОМ ({} х 12.0) кирпич"
    texts = ["обложка", title.format(9), "Болт M16x2", title.format(8) + "\nСт0"]
    rows = [("alb", k + 1, t) for k, t in enumerate(texts)]
    given = spark.createDataFrame(rows, "doc_id string, page_number int, pdf_text string").withColumns({c: F.lit(None).cast("string") for c in ("ocr_text", "ocr_engine", "caption")})
    (a,) = analysis.analyze_albums(given, spec(spark), RULES, embed, projects_dir="/p").collect()
    assert [(b["start_page"], b["end_page"]) for b in a["split_boundaries"]] == [(2, 3), (4, 4)]
    assert a["compliant"] == ["project_zhdom_9x12_0_kirpich"] and a["non_compliant"] == ["project_zhdom_8x12_0_kirpich"]
    named.write_albums(analysis.analyze_albums(given, spec(spark), RULES, embed, projects_dir="/p", files=spark.createDataFrame([], "path string")), str(tmp_path / "a"))
    assert json.loads((tmp_path / "a" / "alb_pipeline_report.json").read_text())["projects"] == []


def test_a_run_goes_on_after_its_last_stage(spark, tmp_path):
    folder, asked = str(tmp_path / "run"), spark.sparkContext.accumulator(0)

    def failing(rows):
        raise RuntimeError("the service is away")

    def ask(rows):
        return rows.withColumn("raw", F.lit('{"elements": [], "compliance": {"is_compliant": true}}'))

    def counted(rows):
        asked.add(1)
        return embed(rows)

    with pytest.raises(RuntimeError):
        analysis.analyze(pages(spark), spec(spark), RULES, counted, failing, folder=folder)
    before = asked.value
    assert Stages(spark, folder).done("hits") and not Stages(spark, folder).done("replies")
    again = analysis.analyze(pages(spark), spec(spark), RULES, counted, ask, folder=folder).collect()
    assert asked.value == before and {r["llm_used"] for r in again} == {True}
    Stages(spark, folder).drop()
    assert not (tmp_path / "run").exists()


def test_services_that_hang_fail_or_say_nothing(spark):
    def start():
        tried = {}

        def service(prompt):
            kind = prompt.split("|")[0]
            tried[kind] = tried.get(kind, 0) + 1
            if kind == "hangs":
                time.sleep(60)
            if kind == "raises" or (kind == "second" and tried[kind] == 1):
                raise OSError("away")
            return "" if kind == "empty" else f"said {kind}"

        return service

    kinds = ["fine", "hangs", "raises", "empty", "second", None, "last"]
    rows = spark.createDataFrame([(k, f"{x}|" if x else None) for k, x in enumerate(kinds)], "k int, prompt string").coalesce(1)
    began = time.monotonic()
    got = services.asked(rows, start, "prompt", "raw", at_once=3, seconds=2.0, tries=2).collect()
    assert time.monotonic() - began < 30
    assert [r["k"] for r in got] == list(range(7))
    assert [r["raw"] for r in got] == ["said fine", None, None, "", "said second", None, "said last"]
    assert [r["raw_error"] for r in got] == [None, services.TIMED_OUT, "OSError: away", None, None, None, None]
    replies = services.language_model(start, seconds=2.0)(rows).collect()
    assert [r["raw"] for r in replies] == ["said fine", None, None, None, None, None, "said last"]
    images = rows.select("k", F.encode("prompt", "UTF-8").alias("image"))
    said = [r["caption"] for r in services.captions(images, lambda: lambda image: start()(image.decode()) if b"second" not in image else " seen ", seconds=2.0).collect()]
    assert said[0] == "said fine" and said[1].startswith("[ОШИБКА") and said[2].startswith("[ОШИБКА") and said[3] == services.CAPTION_EMPTY and said[4] == "seen" and said[5] is None


def test_reports_of_sheets_without_an_answer(spark):
    """A service that is away gives the gate's report, and the text's mentions are judged."""
    ask = services.language_model(lambda: lambda prompt: 1 / 0)
    got = analysis.analyze(pages(spark), spec(spark), RULES, embed, ask).collect()
    assert not any(r["llm_used"] for r in got) and all("недоступна" in r["compliance"]["missing_info"][0] for r in got)
    assert {r["compliance"]["is_compliant"] for r in got} == {True, False}


def lines():
    """A parser of files whose lines are their pages."""

    class Lines:
        """A file whose lines are its pages."""

        def __init__(self, content):
            self.lines = content.decode().splitlines()
            self.pages = len(self.lines)

        def page(self, number, wanted):
            made = {"pdf_text": lambda: self.lines[number - 1], "image": lambda: b"i" * number, "has_drawings": lambda: number % 2 == 1}
            return {c: made[c]() for c in wanted}

    return Lines


def test_pages_of_files_are_dealt_to_tasks(spark, tmp_path):
    parser = lines()
    (tmp_path / "a.pdf").write_text("".join(f"page {k}\n" for k in range(1000)))
    (tmp_path / "b.pdf").write_text("one\n")
    (tmp_path / "c.txt").write_text("no\n")
    few = paged.read_pages(spark, str(tmp_path), parser, "doc_id string, page_number int, pdf_text string", share_bytes=2000)
    assert few.rdd.getNumPartitions() == 6 and few.columns == ["doc_id", "page_number", "pdf_text"]
    rows = sorted(tuple(r) for r in few.collect())
    assert rows == [("a", k + 1, f"page {k}") for k in range(1000)] + [("b", 1, "one")]
    whole = paged.read_pages(spark, str(tmp_path / "b.pdf"), parser).first()
    assert (whole["total_pages"], bytes(whole["image"]), whole["has_drawings"]) == (1, b"i", True)
    assert paged.read_pages(spark, str(tmp_path), parser, "page_number int, total_pages int").where("total_pages = 1000").count() == 1000
    named.write_page_texts(few.where("doc_id = 'b'").withColumns({"image_path": F.lit(None).cast("string"), "has_drawings": F.lit(True)}), str(tmp_path / "out"), "doc_id")
    assert json.loads((tmp_path / "out" / "b_page_001.json").read_text()) == {"page_number": 1, "pdf_text": "one", "image_path": None, "has_drawings": True}
    with pytest.raises(Exception, match="FileNotFoundError"):
        paged.read_pages(spark, str(tmp_path / "none"), parser).count()


def test_many_small_files_have_few_tasks(spark, tmp_path):
    """Tasks follow the bytes, not the number of files; shares come once each, and a file is opened once where one task has it."""
    sizes = [(f"{k:05d}", size) for k, size in enumerate([7 * k % 5000 for k in range(20_000)] + [90_000_000])]
    tasks = paged.dealt(sizes, 1000)
    shares = [(path, s) for t in tasks for path, first, end, _ in t.parts for s in range(first, end)]
    assert shares == [(path, s) for path, size in sizes for s in range(max(1, -(-size // 1000)))] and len(tasks) <= paged.FEW + 1
    assert len(paged.dealt([(f"{k:06d}", 100) for k in range(400_000)], 1000)) <= paged.FEW + 1
    for k in range(400):
        (tmp_path / f"f{k:03d}.pdf").write_text("".join(f"page {j}\n" for j in range(k % 7)))
    few = paged.read_pages(spark, str(tmp_path), lines(), "doc_id string, page_number int, pdf_text string", share_bytes=20)
    assert few.rdd.getNumPartitions() <= paged.FEW + 1
    assert sorted(tuple(r) for r in few.collect()) == [(f"f{k:03d}", j + 1, f"page {j}") for k in range(400) for j in range(k % 7)]


def test_split_files_that_do_not_open(spark):
    flags = "is_drawing boolean, is_explication boolean, is_annotation boolean, is_project_info boolean, is_irrelevant_photo_or_ad boolean, support_text boolean"
    rows = [("good.pdf", 1, True, False, False, False, False, False, None), ("bad.pdf", None, None, None, None, None, None, None, "no objects found")]
    got = {r["file"]: r for r in segment.checked_files(spark.createDataFrame(rows, f"file string, page_number int, {flags}, error string")).collect()}
    assert got["good.pdf"]["status"] == "ok" and got["bad.pdf"]["status"] == "suspicious" and got["bad.pdf"]["n_pages"] == 0
    assert got["bad.pdf"]["reason"] == "не удалось открыть или обработать PDF: no objects found"
