"""Rule checks of drawing elements, and the three-valued verdict of a report.

Rules are configuration: a dict of the rules file, small by nature, which becomes literals of the plan. Issues are
structs (field, actual_value, expected, message, tz_reference); checks are Columns that are null where all is well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import first_number, pattern, strip

ISSUE = "struct<field:string,actual_value:string,expected:string,message:string,tz_reference:string>"
#: Fixed value: what looks like a coating code.
COATING = r"\b(Хим\.\w+|Ц\d+|Н\d+|Кд\d+|Ан\.\w+)\b"
UNNAMED = "неизвестный элемент"
MISSING = {
    "no rules": "rules.json пустой — детерминированная проверка пропущена",
    "not found": "В тексте страницы не найдены параметры по rules.json — сравнить с ТЗ нельзя",
    "not extracted": "Элементы чертежа не извлечены — статус соответствия не определён",
    "without model": "Проверка без текстовой LLM: эвристика + rules.json; возможны пропуски",
    "undecided": "LLM не дал однозначного вывода — детерминированных расхождений не обнаружено",
}


def _present(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def _texts(values: list) -> list[str]:
    return [str(v).strip() for v in values]


def _reference(rule: dict) -> str:
    ref, std = rule.get("tz_reference", ""), rule.get("standard", "")
    return f"{ref} (стандарт: {std})" if ref else std


def _issue(field: Column, actual: Column, expected: str, message: Column, reference: str) -> Column:
    return F.struct(field.alias("field"), actual.alias("actual_value"), F.lit(expected).alias("expected"), message.alias("message"), F.lit(reference).alias("tz_reference"))


def number_text(col: Column) -> Column:
    """A double as people write it: at least one decimal, no exponent below 1e16."""
    plain = F.regexp_replace(F.format_string("%.15f", col), r"0+$", "")
    return F.when(F.abs(col) < 1e7, col.cast("string")).otherwise(F.regexp_replace(plain, r"\.$", ".0"))


def dimension_issue(value: Column, rule: dict, field: Column) -> Column:
    """A list of allowed values comes before a range; bounds are allowed; what has no number passes a range."""
    unit, ref = rule.get("unit", ""), _reference(rule)
    if "allowed_values" in rule:
        allowed = _texts(rule["allowed_values"])
        said = F.concat(F.lit("'"), value, F.lit(f"' не входит в список допустимых значений [{', '.join(allowed)}]"))
        return F.when(_present(value) & ~strip(value).isin(allowed), _issue(field, value, f"одно из: {', '.join(allowed)}", said, ref))
    low, high = rule.get("min"), rule.get("max")
    number = F.when(_present(value), first_number(value))
    expected = f"{low}–{high} {unit}"

    def off(what: str, bound: float) -> Column:
        return _issue(field, value, expected, F.concat(F.lit("значение "), number_text(number), F.lit(f" {unit} {what} допустимо{'го' if 'меньше' in what else 'е'} {bound} {unit}")), ref)

    found = F.when(F.lit(False), F.lit(None).cast(ISSUE))
    if low is not None:
        found = found.when(number < low, off("меньше минимально", low))
    if high is not None:
        found = found.when(number > high, off("превышает максимально", high))
    return found


def size_issue(size: Column, rules: dict, label: Column) -> Column:
    """Threads against the thread rule; other sizes against the ranges in turn, up to the first that they break."""
    by_field = {r["field"]: r for r in rules.get("dimensions", [])}
    name = lambda f: F.concat(F.lit(f"{f} ("), label, F.lit(")"))
    ranges = [dimension_issue(size, r, name(f)) for f, r in by_field.items() if f != "bolt_size" and ("min" in r or "max" in r)]
    # a value list on another field counts only for sizes with a number, as ranges do
    other = F.when(first_number(size).isNotNull(), F.coalesce(*ranges)) if ranges else F.lit(None).cast(ISSUE)
    if "bolt_size" not in by_field:
        return F.when(_present(size), other)
    return F.when(_present(size), F.when(size.rlike(pattern(r"^M\d+")), dimension_issue(size, by_field["bolt_size"], name("bolt_size"))).otherwise(other))


def material_issue(material: Column, rules: dict) -> tuple[Column, Column]:
    """(issue, what is missing)."""
    own = rules.get("materials", {})
    if not own:
        return F.lit(None).cast(ISSUE), F.lit(None).cast("string")
    allowed, banned, ref = _texts(own.get("allowed", [])), _texts(own.get("forbidden", [])), _reference(own)
    expected, field, bare = f"одна из: {', '.join(allowed)}", F.lit("material"), strip(material)
    missing = F.when(~_present(material), F.lit(f"Марка материала не указана на чертеже (требование: {own.get('tz_reference', '')})"))
    said = lambda what: F.concat(F.lit("Материал '"), material, F.lit(what))
    found = F.when(~_present(material), F.lit(None).cast(ISSUE))
    if banned:
        found = found.when(bare.isin(banned), _issue(field, material, expected, said("' входит в список запрещённых"), ref))
    if allowed:
        found = found.when(~bare.isin(allowed), _issue(field, material, expected, said(f"' отсутствует в списке допустимых: [{', '.join(allowed)}]"), ref))
    return found, missing


def designation_issue(designation: Column, rules: dict) -> tuple[Column, Column]:
    own = rules.get("designations", {})
    if not own.get("pattern"):
        return F.lit(None).cast(ISSUE), F.lit(None).cast("string")
    p = own["pattern"]
    missing = F.when(~_present(designation), F.lit(f"Конструкторское обозначение не указано на чертеже (требование: {own.get('tz_reference', '')})"))
    said = F.concat(F.lit("Обозначение '"), designation, F.lit(f"' не соответствует паттерну '{p}'"))
    expected = f"паттерн: {p}, примеры: {', '.join(own.get('examples', []))}"
    return F.when(_present(designation) & ~strip(designation).rlike(pattern(f"^(?:{p})")), _issue(F.lit("designation"), designation, expected, said, own.get("tz_reference", ""))), missing


def coating_issue(note: Column, rules: dict) -> Column:
    """Any allowed code in the note passes it; else the first thing that looks like a code is an issue."""
    own = rules.get("coatings", {})
    if not own:
        return F.lit(None).cast(ISSUE)
    codes = _texts(own.get("allowed_codes", []))
    passed = F.lit(False)
    for c in codes:
        passed = passed | note.contains(c)
    found = F.regexp_extract(note, pattern(COATING), 1)
    said = F.concat(F.lit("Код покрытия '"), found, F.lit("' отсутствует в списке допустимых"))
    return F.when(_present(note) & ~passed & (found != ""), _issue(F.lit("coating"), found, f"одно из: {', '.join(codes)}", said, _reference(own)))


def findings(of: Callable[[str], Column], rules: dict) -> tuple[Column, Column]:
    """issues and missing (arrays, in the order size, material, designation, coating) of an element whose fields of() gives."""
    label = F.coalesce(F.nullif(of("item_id"), F.lit("")), F.nullif(of("name"), F.lit("")), F.lit(UNNAMED))
    material, no_material = material_issue(of("material"), rules)
    designation, no_designation = designation_issue(of("designation"), rules)
    found = F.array(size_issue(of("size"), rules, label), material, designation, coating_issue(of("note"), rules))
    lines = F.array(*[F.concat(label, F.lit(": "), m) for m in (no_material, no_designation)])
    return F.array_compact(found), F.array_compact(lines)


def element_findings(elements: DataFrame, rules: dict) -> DataFrame:
    """Adds issues and missing to each element."""
    issues, missing = findings(F.col, rules)
    return elements.withColumns({"issues": issues, "missing": missing})


def verdict(issues: Column, elements: Column, heuristic: Column, prior: Column) -> Column:
    """True, false or null: issues condemn; without elements nothing is known; else clean means compliant, but for a
    heuristic reading, which a verdict from elsewhere outranks."""
    return F.when(issues > 0, False).when(elements == 0, F.lit(None).cast("boolean")).when(heuristic & prior.isNotNull(), prior).otherwise(True)


def remark(issues: Column, elements: Column, heuristic: Column, prior: Column) -> Column:
    """The line that a report's missing information gets with its verdict, or null."""
    return (
        F.when(issues > 0, F.lit(None).cast("string"))
        .when((elements == 0) & heuristic, MISSING["not found"])
        .when(elements == 0, MISSING["not extracted"])
        .when(heuristic, MISSING["without model"])
        .when(prior.isNull(), MISSING["undecided"])
    )


def _added(lines: Column, line: Column) -> Column:
    return F.when(line.isNull() | F.array_contains(lines, line), lines).otherwise(F.array_append(lines, line))


def _verdicts(reports: DataFrame) -> DataFrame:
    """reports with issues and missing_info whole, n_elements and heuristic: their verdict, its line, and confidence."""
    given = F.size("issues"), F.col("n_elements"), F.col("heuristic"), F.col("is_compliant")
    judged = reports.withColumns({"missing_info": _added(F.col("missing_info"), remark(*given)), "is_compliant": verdict(*given)})
    return judged.withColumn("overall_confidence", F.when((F.size("issues") > 0) | (F.size("missing_info") > 0), "medium").otherwise(F.col("overall_confidence")))


def judged(reports: DataFrame, rules: dict) -> DataFrame:
    """validated() for reports that hold their elements (an array of structs): all in the row, without a join."""
    if not rules:
        return reports.withColumn("missing_info", _added(F.col("missing_info"), F.lit(MISSING["no rules"])))
    each = lambda e: F.struct(*[c.alias(n) for c, n in zip(findings(lambda f: e[f], rules), ("issues", "missing"), strict=True)])
    found = reports.withColumns({"n_elements": F.size("elements"), "_found": F.transform("elements", each)})
    whole = found.withColumns({"issues": F.concat("issues", F.flatten("_found.issues")), "missing_info": F.concat("missing_info", F.flatten("_found.missing"))})
    return _verdicts(whole).drop("n_elements", "_found")


def validated(reports: DataFrame, elements: DataFrame, rules: dict) -> DataFrame:
    """reports with is_compliant, issues, missing_info and overall_confidence as the rules have them, and n_elements.

    reports: drawing_id, heuristic, is_compliant, issues, missing_info, overall_confidence; elements: drawing_id, pos,
    item_id, name, size, material, designation, note. Without rules only a line about that is added.
    """
    found = element_findings(elements, rules).groupBy("drawing_id").agg(
        F.count("*").alias("n_elements"), F.sort_array(F.collect_list(F.struct("pos", "issues"))).alias("i"), F.sort_array(F.collect_list(F.struct("pos", "missing"))).alias("m")
    )
    joined = reports.join(found, "drawing_id", "left").withColumn("n_elements", F.coalesce("n_elements", F.lit(0)))
    if not rules:
        return joined.drop("i", "m").withColumn("missing_info", _added(F.col("missing_info"), F.lit(MISSING["no rules"])))
    empty = lambda c, kind: F.coalesce(F.flatten(c), F.array().cast(kind))
    joined = joined.withColumns({"issues": F.concat("issues", empty("i.issues", f"array<{ISSUE}>")), "missing_info": F.concat("missing_info", empty("m.missing", "array<string>"))}).drop("i", "m")
    return _verdicts(joined)


def first_violations(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """id, value, field, ord of the first range (by ord) that each value is outside of, nulls where there is none.

    values: id (unique), value; ranges: ord, field, low, high. The ranges are kept as one array of structs, so each
    value meets them in its own row: no join whose rows multiply.
    """
    held = ranges.agg(F.sort_array(F.collect_list(F.struct("ord", "field", "low", "high"))).alias("ranges"))
    broken = lambda r: (F.col("value") < r["low"]) | (F.col("value") > r["high"])
    met = values.crossJoin(F.broadcast(held)).withColumn("first", F.try_element_at(F.filter("ranges", broken), F.lit(1)))  # one row
    return met.select("id", "value", F.col("first.field").alias("field"), F.col("first.ord").alias("ord"))


def by_allowance(elements: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    """elements with kind: allowed where their value of on stands in allowed, else other; a null is other."""
    of = lambda join, kind: elements.join(allowed.select(on), on, join).withColumn("kind", F.lit(kind))
    return of("left_semi", "allowed").unionByName(of("left_anti", "other"))


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of each key the first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
