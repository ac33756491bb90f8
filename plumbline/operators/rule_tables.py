"""Rules as a table: one row for each specification, joined to the elements that it governs.

operators.rules makes a plan of one rules file. Here rules are data, so that albums with different specifications are judged
in one job: rules of a specification are one row of structs, which a join by its name brings to each element (Spark
broadcasts the table where its size allows), and each element is judged in its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import first_number, pattern, strip
from plumbline.operators.rules import COATING, ISSUE, UNNAMED, number_text

DIMENSION = "struct<field:string,description:string,allowed_values:array<string>,min:double,max:double,unit:string,standard:string,tz_reference:string>"
RULES = (
    f"dimensions array<{DIMENSION}>, materials struct<allowed:array<string>,forbidden:array<string>,standard:string,tz_reference:string>, "
    "designations struct<pattern:string,examples:array<string>,tz_reference:string>, coatings struct<allowed_codes:array<string>,standard:string,tz_reference:string>"
)
NAMES = ("dimensions", "materials", "designations", "coatings")
BOLT = "bolt_size"
#: Fixed value: how the sentences of the rules begin.
HEADING = "=== Машиночитаемые правила ТЗ ===\n"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """spec (a file's name without its ending) and the rules of each JSON file of path; what is no JSON has none."""
    read = spark.read.schema(RULES).json(path, multiLine=True, mode="PERMISSIVE")
    return read.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("spec"), *NAMES)


def by_specification(dimensions: DataFrame, others: DataFrame) -> DataFrame:
    """One row for each spec of others (spec, materials, designations, coatings), with its dimensions (spec, ord, and the
    fields of a dimension) by ord. Of a field that comes again the last rule counts, in the place of the first."""
    fields = [f.split(":")[0] for f in ("field", "description", "allowed_values", "min", "max", "unit", "standard", "tz_reference")]
    last = dimensions.groupBy("spec", "field").agg(F.min("ord").alias("_first"), F.max_by(F.struct(*fields), "ord").alias("_rule"))
    own = last.groupBy("spec").agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", "_rule"))), lambda x: x["_rule"]).cast(f"array<{DIMENSION}>").alias("dimensions"))
    return others.join(own, "spec", "left").select("spec", F.coalesce("dimensions", F.array().cast(f"array<{DIMENSION}>")).alias("dimensions"), "materials", "designations", "coatings")


def _said(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _present(col: Column) -> Column:
    return _said(col) != ""


def _listed(values: Column) -> Column:
    return F.transform(values, strip)


def _reference(rule: Column) -> Column:
    ref, std = _said(rule["tz_reference"]), _said(rule["standard"])
    return F.when(ref != "", F.concat(ref, F.lit(" (стандарт: "), std, F.lit(")"))).otherwise(std)


def _issue(field: Column, actual: Column, expected: Column, message: Column, reference: Column) -> Column:
    return F.struct(field.alias("field"), actual.alias("actual_value"), expected.alias("expected"), message.alias("message"), reference.alias("tz_reference"))


def _dimension(value: Column, rule: Column, field: Column) -> Column:
    """A list of allowed values comes before a range; bounds are allowed; what has no number passes a range."""
    allowed = F.array_join(_listed(rule["allowed_values"]), ", ")
    unlisted = F.when(
        _present(value) & ~F.array_contains(_listed(rule["allowed_values"]), strip(value)),
        _issue(field, value, F.concat(F.lit("одно из: "), allowed), F.concat(F.lit("'"), value, F.lit("' не входит в список допустимых значений ["), allowed, F.lit("]")), _reference(rule)),
    )
    number, unit = first_number(value), _said(rule["unit"])
    bound = lambda b: F.when(b.isNotNull(), number_text(b)).otherwise("None")
    expected = F.concat(bound(rule["min"]), F.lit("–"), bound(rule["max"]), F.lit(" "), unit)
    off = lambda what, b: _issue(field, value, expected, F.concat(F.lit("значение "), number_text(number), F.lit(" "), unit, F.lit(what), number_text(b), F.lit(" "), unit), _reference(rule))
    ranged = F.when(number < rule["min"], off(" меньше минимально допустимого ", rule["min"])).when(number > rule["max"], off(" превышает максимально допустимое ", rule["max"]))
    return F.when(rule["allowed_values"].isNotNull(), unlisted).otherwise(ranged)


def _size(size: Column, dimensions: Column, label: Column) -> Column:
    """Threads against the thread rule; other sizes against the ranges in turn, up to the first that they break."""
    named = lambda d: F.concat(d["field"], F.lit(" ("), label, F.lit(")"))
    ranges = F.filter(dimensions, lambda d: (d["field"] != BOLT) & (d["min"].isNotNull() | d["max"].isNotNull()))
    broken = F.filter(F.transform(ranges, lambda d: _dimension(size, d, named(d))), lambda i: i.isNotNull())
    other = F.when(first_number(size).isNotNull(), F.get(broken, 0))
    bolts = F.filter(dimensions, lambda d: d["field"] == BOLT)
    thread = F.get(F.transform(bolts, lambda d: _dimension(size, d, named(d))), 0)
    return F.when(_present(size), F.when((F.size(bolts) > 0) & size.rlike(pattern(r"^M\d+")), thread).otherwise(other))


def findings(of: Callable[[str], Column], rule: Callable[[str], Column]) -> tuple[Column, Column]:
    """issues and missing (arrays, in the order size, material, designation, coating) of an element under its rules."""
    label = F.coalesce(F.nullif(of("item_id"), F.lit("")), F.nullif(of("name"), F.lit("")), F.lit(UNNAMED))
    m, d, c = (rule(n) for n in NAMES[1:])
    material, allowed = of("material"), _listed(m["allowed"])
    listed = F.coalesce(F.array_join(allowed, ", "), F.lit(""))
    said = lambda *what: F.concat(F.lit("Материал '"), material, *what)
    about = lambda message: _issue(F.lit("material"), material, F.concat(F.lit("одна из: "), listed), message, _reference(m))
    banned = F.coalesce(F.array_contains(_listed(m["forbidden"]), strip(material)), F.lit(False))
    unknown = (F.coalesce(F.size(allowed), F.lit(0)) > 0) & ~F.array_contains(allowed, strip(material))
    of_material = F.when(_present(material), F.when(banned, about(said(F.lit("' входит в список запрещённых")))).when(unknown, about(said(F.lit("' отсутствует в списке допустимых: ["), listed, F.lit("]")))))
    no_material = F.when(m.isNotNull() & ~_present(material), F.concat(F.lit("Марка материала не указана на чертеже (требование: "), _said(m["tz_reference"]), F.lit(")")))
    name, p = of("designation"), d["pattern"]
    wrong = _present(p) & _present(name) & ~F.rlike(strip(name), F.concat(F.lit(pattern("^(?:")), p, F.lit(")")))
    examples = F.coalesce(F.array_join(d["examples"], ", "), F.lit(""))
    of_name = F.when(wrong, _issue(F.lit("designation"), name, F.concat(F.lit("паттерн: "), p, F.lit(", примеры: "), examples), F.concat(F.lit("Обозначение '"), name, F.lit("' не соответствует паттерну '"), p, F.lit("'")), _said(d["tz_reference"])))
    no_name = F.when(_present(p) & ~_present(name), F.concat(F.lit("Конструкторское обозначение не указано на чертеже (требование: "), _said(d["tz_reference"]), F.lit(")")))
    note, codes = of("note"), _listed(c["allowed_codes"])
    code = F.regexp_extract(note, pattern(COATING), 1)
    passed = F.coalesce(F.exists(codes, lambda x: F.contains(note, x)), F.lit(False))
    of_note = F.when(c.isNotNull() & _present(note) & ~passed & (code != ""), _issue(F.lit("coating"), code, F.concat(F.lit("одно из: "), F.coalesce(F.array_join(codes, ", "), F.lit(""))), F.concat(F.lit("Код покрытия '"), code, F.lit("' отсутствует в списке допустимых")), _reference(c)))
    found = F.array(*[x.cast(ISSUE) for x in (_size(of("size"), rule("dimensions"), label), of_material, of_name, of_note)])
    return F.array_compact(found), F.array_compact(F.array(*[F.concat(label, F.lit(": "), x) for x in (no_material, no_name)]))


def element_findings(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """elements (spec, item_id, name, size, material, designation, note) with issues and missing by the rules of their spec;
    those of a spec without rules have none."""
    held = elements.join(rules.select(F.col("spec").alias("_spec"), *[F.col(n).alias(f"_{n}") for n in NAMES]), F.col("spec") == F.col("_spec"), "left")
    issues, missing = findings(F.col, lambda n: F.col(f"_{n}"))
    return held.withColumns({"issues": issues, "missing": missing}).drop("_spec", *[f"_{n}" for n in NAMES])


def sentences(rules: DataFrame) -> DataFrame:
    """spec, text: the rules of each specification as sentences, for its index."""
    bound = lambda b: number_text(b)
    joined = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))

    def dimension(d: Column) -> Column:
        about = F.concat(F.lit("Поле '"), d["field"], F.lit("' ("), _said(d["description"]), F.lit("): "))
        tail = F.concat(F.lit("Стандарт: "), _said(d["standard"]), F.lit(". Ссылка: "), _said(d["tz_reference"]), F.lit("."))
        listed = F.concat(about, F.lit("допустимые значения: "), joined(d["allowed_values"]), F.lit(". Единица: "), _said(d["unit"]), F.lit(". "), tail)
        ranged = F.concat(about, F.lit("диапазон "), bound(d["min"]), F.lit("–"), bound(d["max"]), F.lit(" "), _said(d["unit"]), F.lit(". "), tail)
        return F.when(d["allowed_values"].isNotNull(), listed).when(d["min"].isNotNull() & d["max"].isNotNull(), ranged)

    m, d, c = (F.col(n) for n in NAMES[1:])
    ends = lambda x: F.concat(F.lit(". Стандарт: "), _said(x["standard"]), F.lit(". Ссылка: "), _said(x["tz_reference"]), F.lit("."))
    lines = [
        F.when(m.isNotNull(), F.concat(F.lit("Материалы: допустимые: "), joined(m["allowed"]), F.lit(". Запрещённые: "), joined(m["forbidden"]), ends(m))),
        F.when(d.isNotNull(), F.concat(F.lit("Обозначения: паттерн '"), _said(d["pattern"]), F.lit("'. Примеры: "), joined(d["examples"]), F.lit(". Ссылка: "), _said(d["tz_reference"]), F.lit("."))),
        F.when(c.isNotNull(), F.concat(F.lit("Покрытия: допустимые коды: "), joined(c["allowed_codes"]), ends(c))),
    ]
    every = F.array_compact(F.concat(F.array(F.lit(HEADING)), F.transform(F.coalesce("dimensions", F.array().cast(f"array<{DIMENSION}>")), dimension), F.array(*lines)))
    return rules.select("spec", F.array_join(every, "\n").alias("text"))
