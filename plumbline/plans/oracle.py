"""DuckDB SQL that gives the rows of the catalogue's queries, written apart from their plans."""

from __future__ import annotations

_PARTS = """
parts as (
  select p_partkey, p_brand, p_name, case when p_partkey % 7 = 0 then 'M' || p_size else p_size || ' mm' end as size,
    case when p_partkey % 11 <> 0 then p_type end as material, case when p_partkey % 13 <> 0 then p_brand end as designation, p_size
  from part
), found as (
  select *,
    case
      when p_partkey % 7 = 0 then case when size not in ('M8', 'M10') then 'bolt_size' end
      when p_size < 4 or p_size > 46 then 'wall'
      when p_size < 1 or p_size > 40 then 'gap'
    end as f_size,
    case when material = 'PROMO' then 'forbidden' when material not in ('STANDARD', 'MEDIUM', 'LARGE', 'SMALL') then 'unknown' end as f_material,
    designation is not null and not regexp_matches(designation, '^Brand#[0-9]{2}$') as f_designation,
    (material is null)::int + (designation is null)::int as n_missing
  from parts
)"""

_EVENTS = """
pages as (
  select user_id as doc_id, row_number() over (partition by user_id order by ts, event_id) as page, event_type as kind, 'v' || floor(value)::bigint as label from events
)"""

_RUNS = (
    _EVENTS
    + """, segmented as (
  select *, 1 + sum((kind = 'signup' and page > 1)::int) over (partition by doc_id order by page) as segment from pages
), zoned as (
  select *, sum((kind = 'error')::int) over (partition by doc_id, segment order by page) as zone from segmented
), bounds as (
  select *, min(page) over z as zone_first, max(page) over z as zone_last from zoned where kind <> 'error' window z as (partition by doc_id, segment, zone)
), steps as (
  select *, coalesce(page - lag(page) over (partition by doc_id, segment, zone order by page) - 1 > 3, true) as new from bounds where kind in ('click', 'view')
), islands as (
  select *, sum(new::int) over (partition by doc_id, segment, zone order by page) as run from steps
), runs as (
  select doc_id, segment, zone, run, zone_first, zone_last, min(page) as lo, max(page) as hi, bool_or(kind = 'click') as drawn from islands group by all
), glued as (
  select doc_id, segment, zone, run, drawn, case when run = 1 and lo - zone_first <= 2 then zone_first else lo end as first_page,
    case when run = max(run) over (partition by doc_id, segment, zone) and zone_last - hi <= 2 then zone_last else hi end as last_page
  from runs
)"""
)

_STEMS = (
    _EVENTS
    + """, signed as (
  select doc_id, page, kind as signature, max(page) over (partition by doc_id) as total, kind in ('error', 'view') as blank from pages
), starts as (
  select doc_id, page, signature, total from (select *, lag(signature) over (partition by doc_id order by page) as before from signed where not blank) where before is null or before <> signature
), projects as (
  select doc_id, page as start_page, coalesce(lead(page) over (partition by doc_id order by page) - 1, total) as end_page, signature,
    row_number() over (partition by doc_id, signature order by page) as number
  from starts
), stems as (
  select doc_id, start_page, end_page, signature, case when number = 1 then signature else signature || '_' || number end as stem from projects
)"""
)

_SPLIT = (
    _EVENTS
    + """, files as (
  select 'drawing_' || doc_id || '_' || floor((page - 1) / 3)::bigint || '.pdf' as file, count(*) as n_pages, bool_or(kind = 'click') as drawn,
    coalesce(string_agg(case when kind = 'error' then page::varchar end, ', ' order by page), '') as ads, bool_or(kind in ('view', 'purchase')) as supported
  from pages group by 1
), checked as (
  select file, n_pages, concat_ws('; ', case when not drawn then 'ни одна страница не распознана как чертёж' end,
    case when ads <> '' then 'страницы с маркерами рекламы/фото: ' || ads end,
    case when n_pages >= 2 and not supported then 'несколько страниц без экспликации/примечаний и без явных размеров/масштаба в тексте' end) as why
  from files
)"""
)

_PAGES = r"""
pages as (
  select doc_id, text as raw, trim(regexp_replace(lower(text), '[\s\x{A0}\x{3000}]+', ' ', 'g')) as t, upper(trim(regexp_replace(text, '[\s\x{A0}\x{3000}]+', ' ', 'g'))) as u from documents
), sized as (
  select *, length(t) as n, length(t) % 4 as images, (length(t) % 10) / 10.0::double as ratio from pages
), marked as (
  select *, contains(t, 'licensed') or contains(t, 'http://') or contains(t, 'https://') or contains(u, 'COPYRIGHT') as ads,
    case when regexp_matches(t, 'ertion\s+the|stand|tion,\s+the') then 0.88 when regexp_matches(t, 'nder|keit') then 0.42 else 0 end::double as drawing,
    case when regexp_matches(t, 'mentre|the\s+thnt') then 0.9 when regexp_matches(t, 'eaux|ción') then 0.48 else 0 end::double as explication,
    contains(t, 'ing,')::int + contains(t, 'heit')::int + regexp_matches(t, 'of\s+the\s+')::int + contains(t, 'eren')::int + contains(t, 'ement')::int + regexp_matches(t, '\.\n?\s*th')::int as hits,
    regexp_matches(t, '\d{2,4}\s*[x]\s*\d{2,4}|\d+\s*[=]\s*\d+') as dims, regexp_matches(t, 'here\s+|ungen') as proj
  from sized
), scored as (
  select *, case when drawing > 0 then 0.0 else greatest(case when hits > 0 then 0.35 + least(0.45, 0.12 * hits) else 0 end, case when dims then 0.4 else 0 end) end::double as annotation,
    greatest(case when contains(t, 'thing') or contains(t, 'ouan') then 0.35 else 0 end, case when n < 220 and (ratio >= 0.38 or images >= 2) then 0.55 else 0 end,
      case when n < 80 and images >= 1 then 0.45 else 0 end, case when ads then 0.95 else 0 end)::double as ad
  from marked
)"""

_VALIDATED = (
    _PARTS
    + """, seen as (
  select p_brand, p_partkey::varchar as drawing_id, p_partkey, p_partkey % 2 = 0 as heuristic, case p_partkey % 3 when 0 then true when 1 then false end as prior, 1 as n_elements,
    (f_size is not null)::int + (f_material is not null)::int + coalesce(f_designation, false)::int as n_issues,
    concat_ws(' | ', case when material is null then p_partkey || ': Марка материала не указана на чертеже (требование: 4)' end,
      case when designation is null then p_partkey || ': Конструкторское обозначение не указано на чертеже (требование: 5)' end) as missing
  from found
), judged as (
  select *, case when n_issues > 0 then false when n_elements = 0 then null when heuristic and prior is not null then prior else true end as is_compliant,
    case when n_issues > 0 then null when n_elements = 0 and heuristic then 'В тексте страницы не найдены параметры по rules.json — сравнить с ТЗ нельзя'
      when n_elements = 0 then 'Элементы чертежа не извлечены — статус соответствия не определён'
      when heuristic then 'Проверка без текстовой LLM: эвристика + rules.json; возможны пропуски'
      when prior is null then 'LLM не дал однозначного вывода — детерминированных расхождений не обнаружено' end as remark
  from seen
)"""
)

#: Conversations as sheets; {sheet} is what names one, {blank} what stands for a page number.
_TALKS = r"""
turns as (
  select *, 'c' || conv_id as base, {sheet} as drawing_id, case role when 'system' then 0 when 'user' then 1 else 2 end as kind,
    case role when 'system' then '[PDF стр.' || turn || ']' when 'user' then '[OCR стр.' || turn || ' (tesseract)]' else '[LLaVA стр.' || turn || ']' end || chr(10) || text as part, trim(text) <> '' as filled
  from conversations
), sheets as (
  select drawing_id, base, coalesce(string_agg(case when filled then part end, chr(10) || chr(10) order by kind, turn), '') as text from turns group by 1, 2
), chunks as (
  select item_id::varchar || '#000000' as id, trim(text) as text from benchmark where trim(text) <> ''
  union all select 'rules.json#000000', '=== Машиночитаемые правила ТЗ ===' || chr(10) || chr(10) || {rules}
), letters as (select unnest(['a', 'e', 'i', 'o', 'u', 'd', 'l', 'n', 'r', 's', 't']) as x, generate_subscripts(['a', 'e', 'i', 'o', 'u', 'd', 'l', 'n', 'r', 's', 't'], 1) as place
), chunk_counts as (
  select id, list((length(text) - length(replace(lower(text), x, '')))::double order by place) as v from chunks, letters group by 1
), sheet_counts as (
  select drawing_id, list((length(q) - length(replace(lower(q), x, '')))::double order by place) as v
  from (select drawing_id, case when trim(text) <> '' then left(text, 800) else 'техническое задание требования материалы' end as q from sheets), letters group by 1
), scored as (
  select s.drawing_id, c.id, list_inner_product(s.v, c.v) / nullif(sqrt(list_inner_product(s.v, s.v)), 0) / nullif(sqrt(list_inner_product(c.v, c.v)), 0) as score from sheet_counts s, chunk_counts c
), hits as (
  select * from (select *, row_number() over (partition by drawing_id order by round(coalesce(score, 0), 12) desc, id) as rank from scored) where rank <= 3
), used as (
  select drawing_id, string_agg(text, '|' order by rank) as used, string_agg('[' || rank || '] Источник: ' || split_part(id, '#', 1) || ' (релевантность: 0.25)' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as blocks
  from hits join chunks using (id) group by 1
), replied as (
  select *, {reply} as k from sheets
), mentions as (
  select *, contains(lower(text), 'tion')::int + contains(lower(text), 'ment')::int as sizes, contains(text, 'keit')::int as good, contains(text, 'stand')::int as bad from replied
), counted as (
  select *, k in (1, 2) as llm_used, case when k = 1 then 1 else sizes + good + bad end as n_elements, case when k = 1 then 0 else bad end as n_issues,
    case when k = 1 then 0 else sizes end + case when k in (1, 2) then 0 else 1 end as lines, k <> 1 and (k not in (2, 3) or sizes + good + bad > 0) as heuristic from mentions
), remarked as (
  select *, case when n_issues > 0 then false when n_elements = 0 then null when heuristic and k = 2 then true else true end as is_compliant, lines + (case when n_issues > 0 then 0 when n_elements = 0 then 1 when heuristic then 1 when k = 1 then 1 else 0 end) as n_missing from counted
), reported as (
  select r.*, k in (1, 2, 3) as asked, case when n_issues > 0 or n_missing > 0 then 'medium' when k = 1 then 'high' else 'low' end as overall_confidence, md5(used) as chunks_md5, blocks from remarked r join used using (drawing_id)
)"""
_TALK_SENTENCES = "'Поле ''bolt_size'' (): допустимые значения: tion, ment. Единица: . Стандарт: . Ссылка: .' || chr(10) || 'Поле ''bolt_size'' (): допустимые значения: the. Единица: . Стандарт: . Ссылка: .' || chr(10) || 'Материалы: допустимые: keit. Запрещённые: stand. Стандарт: . Ссылка: 7.'"
_BY_TALK = _TALKS.replace("{sheet}", "'c' || conv_id").replace("{rules}", _TALK_SENTENCES).replace("{reply}", "length(text) % 4")
_BY_TURN = _TALKS.replace("{sheet}", "'c' || conv_id || '-стр.' || turn").replace("{rules}", _TALK_SENTENCES).replace("{reply}", "0")

_BRANDS = (
    _PARTS
    + """, brands as (
  select p_brand as spec, min(p_size) as low, max(p_size) as high, list(distinct p_type order by p_type) as types, coalesce(list(distinct p_type order by p_type) filter (where p_size > 40), []) as large from part where p_partkey % 2 = 0 group by 1
), ruled as (
  select *, (low + 5)::double as lo, (high - 5)::double as hi, ['M' || low, 'M' || high] as bolts, array_to_string(types[1:4], ', ') as allowed, '1 (стандарт: S ' || spec || ')' as ref from brands
)"""
)

_ASKED = _TALKS.replace("{sheet}", "'c' || conv_id").replace("{rules}", _TALK_SENTENCES).replace("{reply}", "length(left(text, 3000)) % 4")
_REPORTED = """
select drawing_id, n_elements, n_issues, n_missing, is_compliant, overall_confidence, asked as llm_used, chunks_md5,
  'Чертёж ' || drawing_id || ': ' || case when is_compliant then 'СООТВЕТСТВУЕТ' when not is_compliant then 'НЕ СООТВЕТСТВУЕТ' else 'НЕЛЬЗЯ ОПРЕДЕЛИТЬ' end || ' | Элементов: ' || n_elements || ' | Расхождений: ' || n_issues || ' | Не определено: ' || n_missing as summary from reported"""
#: Reports whose replies hang on what a prompt shows of a text.
BY_ASKED = f"with {_ASKED} {_REPORTED}"

ORACLE_SQL = {
    "report_verdicts": f"""with {_VALIDATED}
select drawing_id, n_elements, n_issues, concat_ws(' | ', nullif(missing, ''), remark) as missing_info, is_compliant,
  case when n_issues > 0 or missing <> '' or remark is not null then 'medium' else 'high' end as overall_confidence,
  case when is_compliant then '✓ СООТВЕТСТВУЕТ' when not is_compliant then '✗ НЕ СООТВЕТСТВУЕТ' else '? НЕ ОПРЕДЕЛЕНО' end as label
from judged""",
    "element_issues": f"""with {_PARTS}, rows as (
  select p_partkey, n_missing, 1 as k, f_size || ' (' || p_partkey || ')' as field, size as actual_value,
    case f_size when 'bolt_size' then 'одно из: M8, M10' when 'wall' then '4.0–46.0 mm' else '1.0–40.0 mm' end as expected,
    case f_size when 'bolt_size' then '''' || size || ''' не входит в список допустимых значений [M8, M10]'
      when 'wall' then 'значение ' || p_size || '.0 mm ' || case when p_size < 4 then 'меньше минимально допустимого 4.0 mm' else 'превышает максимально допустимое 46.0 mm' end
      else 'значение ' || p_size || '.0 mm ' || case when p_size < 1 then 'меньше минимально допустимого 1.0 mm' else 'превышает максимально допустимое 40.0 mm' end end as message,
    case f_size when 'bolt_size' then '1 (стандарт: S1)' when 'wall' then '2 (стандарт: S2)' else 'S3' end as tz_reference
  from found where f_size is not null
  union all
  select p_partkey, n_missing, 2, 'material', material, 'одна из: STANDARD, MEDIUM, LARGE, SMALL',
    'Материал ''' || material || case when f_material = 'forbidden' then ''' входит в список запрещённых' else ''' отсутствует в списке допустимых: [STANDARD, MEDIUM, LARGE, SMALL]' end, '4 (стандарт: S4)'
  from found where f_material is not null
  union all
  select p_partkey, n_missing, 3, 'designation', designation, 'паттерн: ^Brand#[0-9]{{2}}$, примеры: Brand#10', 'Обозначение ''' || designation || ''' не соответствует паттерну ''^Brand#[0-9]{{2}}$''', '5'
  from found where f_designation
)
select p_partkey, found.n_missing, row_number() over (partition by p_partkey order by k) - 1 as ord, field, actual_value, expected, message, tz_reference from rows join found using (p_partkey)
union all select p_partkey, n_missing, null, null, null, null, null, null from found where f_size is null and f_material is null and not coalesce(f_designation, false)""",
    "verdict_buckets": f"""with {_VALIDATED}
select p_brand, count(*) as total_drawings, coalesce(string_agg(case when is_compliant then drawing_id end, ',' order by p_partkey), '') as compliant,
  coalesce(string_agg(case when not is_compliant then drawing_id end, ',' order by p_partkey), '') as non_compliant, coalesce(string_agg(case when is_compliant is null then drawing_id end, ',' order by p_partkey), '') as undetermined
from judged group by 1""",
    "first_violations": """with r as (select l_quantity as v, case when l_quantity < 10 or l_quantity > 50 then 1 when l_quantity < 1 or l_quantity > 30 then 2 when l_quantity < 5 or l_quantity > 45 then 3 end as ord from lineitem)
select case ord when 1 then 'a' when 2 then 'b' when 3 then 'c' end as field, ord, count(*) as n, sum(v) as total from r group by ord""",
    "allowed_materials": "select p_type, count(*) as n, case when p_type in ('STANDARD', 'SMALL') then 'allowed' else 'other' end as kind from part group by 1",
    "page_features": r"""with p as (
  select doc_id, text as raw, trim(regexp_replace(lower(text), '[\s\x{A0}\x{3000}]+', ' ', 'g')) as t from documents
), c as (
  select *, len(regexp_extract_all(raw, '[а-яёА-ЯЁa-zA-Z0-9]')) as meaningful, len(regexp_extract_all(raw, '[A-Za-z]')) as latin, len(regexp_extract_all(raw, '[\p{L}\p{M}\p{N}_]')) as letters, len(regexp_extract_all(raw, '[\x{0400}-\x{04FF}]')) as cyrillic from p
)
select doc_id, length(t) as char_count, md5(t) as text_md5, contains(raw, chr(65533)) or (letters > 20 and cyrillic < 0.15 * letters) as garbled, meaningful, latin,
  case when meaningful >= 200 then 'high' when meaningful >= 50 then 'medium' else 'low' end as band from c""",
    "page_scores": f"with {_PAGES} select doc_id, round(drawing, 6) as drawing, round(explication, 6) as explication, round(annotation, 6) as annotation, round(ad, 6) as ad from scored",
    "page_classes": rf"""with {_PAGES}, ranked as (
  select *, list_reverse_sort([drawing, explication, annotation, ad]) as s from scored
), best as (
  select *, case when s[1] >= 0.52 and s[1] - s[2] >= 0.12 then s[1] end as b from ranked
)
select doc_id, not ads and coalesce(drawing = b, false) as is_drawing, not ads and coalesce(explication = b, false) as is_explication, not ads and coalesce(annotation = b, false) as is_annotation,
  not ads and proj and (b is null or annotation = b) as is_project_info, ads or coalesce(ad = b, false) as is_irrelevant_photo_or_ad,
  (regexp_matches(left(t, 1800), 'the\s*an') and (contains(left(t, 1800), 'tion') or contains(left(t, 1800), 'keit'))) or contains(left(t, 1800), 'thouin') or contains(left(t, 1800), 'ondre') as begins_new_project
from best""",
    "drawing_runs": f"""with {_RUNS}
select g.doc_id, g.segment, g.zone, run, first_page, last_page, sum((kind = 'click')::int) as drawings
from glued g join zoned z on g.doc_id = z.doc_id and g.segment = z.segment and g.zone = z.zone and page between first_page and last_page and kind <> 'error' where drawn group by all""",
    "drawing_files": f"""with {_RUNS}, paged as (
  select g.doc_id, g.segment, g.zone, run, first_page as run_first, page, kind, label, floor((row_number() over (partition by g.doc_id, g.segment, g.zone, run order by page) - 1) / 5)::int as part
  from glued g join zoned z on g.doc_id = z.doc_id and g.segment = z.segment and g.zone = z.zone and page between first_page and last_page and kind <> 'error' where drawn
), files as (
  select doc_id, segment, zone, run, run_first, part, min(page) as first_page, max(page) as last_page, count(*) as n_pages, string_agg(page::varchar, ',' order by page) as pages,
    coalesce(arg_min(label, page) filter (where kind = 'click'), arg_min(label, page)) as label from paged group by all
), numbered as (
  select *, row_number() over (partition by doc_id order by first_page) as seq, count(*) over (partition by doc_id, segment, zone, run) > 1 as cut from files
), named as (
  select *, printf('drawing_p%02d_', segment::int) || label || case when cut then printf('_p%03d', seq::int) else '' end as base from numbered
)
select doc_id, seq, segment, run_first, first_page, last_page, n_pages, pages,
  base || case when row_number() over (partition by doc_id, base order by seq) > 1 then '_' || (row_number() over (partition by doc_id, base order by seq) - 1) else '' end as stem
from named""",
    "project_boundaries": f"with {_STEMS} select doc_id, start_page, end_page, signature, stem from stems",
    "project_pages": f"with {_STEMS} select s.doc_id, stem, count(*) as n, min(page) as first_page from stems s join pages p on s.doc_id = p.doc_id and page between start_page and end_page group by all",
    "split_check": f"with {_SPLIT} select file, n_pages, case when why = '' then 'ok' else 'suspicious' end as status, case when why = '' then 'чертёж найден, реклама/фото не обнаружены, контент выглядит согласованным' else why end as reason from checked",
    "split_advice": f"""with {_SPLIT}, n as (select count(*) as total, count(*) filter (where why <> '') as suspicious from checked)
select total, suspicious, case when total = 0 then 'empty' when suspicious = 0 then 'none' when suspicious <= greatest(1, total // 5) then 'few' when suspicious >= greatest(2, floor(total * 0.4)) then 'many' else 'some' end as advice from n""",
    "fused_texts": """with parts as (
  select conv_id, turn, case role when 'system' then 0 when 'user' then 1 else 2 end as kind,
    case role when 'system' then '[PDF стр.' || turn || ']' when 'user' then '[OCR стр.' || turn || ' (tesseract)]' else '[LLaVA стр.' || turn || ']' end || chr(10) || text as part, trim(text) <> '' as filled
  from conversations
), fused as (select conv_id, coalesce(string_agg(case when filled then part end, chr(10) || chr(10) order by kind, turn), '') as text from parts group by 1)
select conv_id, length(text) as n, md5(text) as text_md5, md5(case when trim(text) <> '' then left(text, 800) else 'Требования к материалам, размерам и обозначениям' end) as query_md5 from fused""",
    "ocr_choice": """with d as (
  select doc_id, regexp_replace(text, '[^0-9]+', ' ', 'g') as a, text as b from documents
), c as (
  select *, len(regexp_extract_all(a, '[а-яёА-ЯЁa-zA-Z0-9]')) as n1, len(regexp_extract_all(b, '[а-яёА-ЯЁa-zA-Z0-9]')) as n2 from d
), e as (select *, n1 < 50 and n2 > n1 as swap from c), f as (select *, case when swap then n2 else n1 end as n from e)
select doc_id, case when swap then 'easyocr' when n1 > 0 then 'tesseract' else 'none' end as engine, case when n >= 200 then 'high' when n >= 50 then 'medium' else 'low' end as confidence, n as char_count,
  md5(case when swap then b when n1 > 0 then a else '' end) as text_md5 from f""",
    "first_numbers": r"select event_id, try_cast(regexp_extract(value::varchar, '[-+]?\d+(\.\d+)?') as double) as number from events",
    "file_stems": r"""with s as (
  select page_id, url as a, html as b from pages
), c as (
  select page_id, regexp_replace(trim(regexp_replace(a, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '\s+', '_', 'g') as a, regexp_replace(trim(regexp_replace(b, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '\s+', '_', 'g') as b from s
)
select page_id, coalesce(nullif(rtrim(left(coalesce(nullif(trim(a, '._'), ''), 'drawing'), 72), '._'), ''), 'drawing') as stem, coalesce(nullif(rtrim(left(coalesce(nullif(trim(b, '._'), ''), 'drawing'), 72), '._'), ''), 'drawing') as html_stem from c""",
    "snippets": r"""with s as (select doc_id, text, strpos(text, 'tion') as place from documents)
select doc_id, case when place = 0 then 'tion' else trim(replace(substr(text, greatest(place - 20, 1), place + 24 - greatest(place - 20, 1)), chr(10), ' ')) end as snippet from s""",
    "image_metrics": "select l_orderkey as doc_id, round(least(1.0, sum(greatest(l_quantity - 5, 0) * greatest(l_discount, 0)) / 10.0), 6) as image_area_ratio, count(distinct l_suppkey) as image_count from lineitem group by 1",
    "placed_images": """with r as (
  select *, l_quantity * 2 - 30 as x0, l_quantity * 2 - 30 + l_linenumber * 4 as x1, l_discount * 800 - 20 as y0, l_discount * 800 - 5 as y1, case when l_orderkey % 9 = 0 then 0 else 40 end as bottom, l_linenumber <> 4 as placed from lineitem
)
select l_orderkey as doc_id, case when max(bottom) = 0 then 0.0 else round(least(1.0, coalesce(sum(case when placed then greatest(least(x1, 45) - greatest(x0, -5), 0) * greatest(least(y1, bottom) - greatest(y0, 0), 0) end), 0) / (50.0 * max(bottom))), 6) end as image_area_ratio,
  case when max(bottom) = 0 then 0 else count(distinct case when placed then l_suppkey end) end as image_count from r group by 1""",
    "page_graphics": """with f as (
  select l_orderkey, l_suppkey, arg_min(l_quantity * 4 * (l_quantity * 2 - 10), l_linenumber * 1000 + l_quantity) as area from lineitem group by 1, 2
), g as (select l_orderkey, max(area) >= 10000 as large from f group by 1)
select o_orderkey as doc_id, coalesce(large, false) or o_orderkey % 8 > 5 as has_drawings from orders left join g on l_orderkey = o_orderkey""",
    "brand_issues": f"""with {_BRANDS}, named as (
  select p.*, case when p_partkey % 13 = 1 then 'none' else designation end as mark, p_partkey % 7 = 0 as thread from parts p
), rows as (
  select p_partkey, 1 as k, 'bolt_size (' || p_partkey || ')' as field, 'одно из: ' || array_to_string(bolts, ', ') as expected, '''' || size || ''' не входит в список допустимых значений [' || array_to_string(bolts, ', ') || ']' as message, ref as tz_reference
  from named join ruled on spec = p_brand where thread and not list_contains(bolts, size)
  union all
  select p_partkey, 1, 'wall (' || p_partkey || ')', lo || '–' || hi || ' mm', 'значение ' || p_size || '.0 mm ' || case when p_size < lo then 'меньше минимально допустимого ' || lo else 'превышает максимально допустимое ' || hi end || ' mm', ref
  from named join ruled on spec = p_brand where not thread and (p_size < lo or p_size > hi)
  union all
  select p_partkey, 2, 'material', 'одна из: ' || allowed, 'Материал ''' || material || case when list_contains(large, material) then ''' входит в список запрещённых' else ''' отсутствует в списке допустимых: [' || allowed || ']' end, '2 (стандарт: )'
  from named join ruled on spec = p_brand where material is not null and (list_contains(large, material) or not list_contains(types[1:4], material))
  union all
  select p_partkey, 3, 'designation', 'паттерн: ' || spec || '$, примеры: ' || spec, 'Обозначение ''none'' не соответствует паттерну ''' || spec || '$''', '3' from named join ruled on spec = p_brand where mark = 'none'
), missed as (
  select p_partkey, concat_ws(' | ', case when material is null then p_partkey || ': Марка материала не указана на чертеже (требование: 2)' end, case when mark is null then p_partkey || ': Конструкторское обозначение не указано на чертеже (требование: 3)' end) as missing from named
)
select p_partkey, missing, case when field is not null then row_number() over (partition by p_partkey order by k) - 1 end as ord, field, expected, message, tz_reference from missed left join rows using (p_partkey)""",
    "brand_sentences": f"""with {_BRANDS}
select spec, '=== Машиночитаемые правила ТЗ ===' || chr(10) || chr(10) || 'Поле ''wall'' (размер): диапазон ' || lo || '–' || hi || ' mm. Стандарт: S ' || spec || '. Ссылка: 1.' || chr(10)
  || 'Поле ''bolt_size'' (размер): допустимые значения: ' || array_to_string(bolts, ', ') || '. Единица: mm. Стандарт: S ' || spec || '. Ссылка: 1.' || chr(10) || 'Материалы: допустимые: ' || allowed || '. Запрещённые: ' || array_to_string(large, ', ') || '. Стандарт: . Ссылка: 2.' || chr(10)
  || 'Обозначения: паттерн ''' || spec || '$''. Примеры: ' || spec || '. Ссылка: 3.' || chr(10) || 'Покрытия: допустимые коды: bolt. Стандарт: S9. Ссылка: .' as text from ruled""",
    "top_chunks": """with s as (
  select q.vec_id as query_id, e.vec_id as id, list_inner_product(q.embedding::double[], e.embedding::double[]) as score from embeddings q, embeddings e where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)
select query_id, rank, id, round(score, 6) as score from r where rank <= 5""",
    "chunks": r"""with recursive paragraphs as (
  select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g')), lambda p: p <> '') as ps from documents
), fold as (
  select doc_id, ps, 1 as i, 0 as j, [] :: varchar[] as ss, '' as cur, null :: varchar as out from paragraphs where len(ps) > 0
  union all
  select doc_id, ps,
    case when j > 0 and j < len(ss) then i when j = 0 and cur = '' and length(ps[i]) > 500 then i else i + 1 end,
    case when j > 0 then case when j < len(ss) then j + 1 else 0 end when cur = '' and length(ps[i]) > 500 then 1 else 0 end,
    case when j = 0 and cur = '' and length(ps[i]) > 500 then string_split(regexp_replace(ps[i], '([.!?])[\s\x{A0}\x{3000}]+', '\1' || chr(1), 'g'), chr(1)) else ss end,
    case when j > 0 then case when length(cur) + length(ss[j]) <= 500 then trim(cur || ' ' || ss[j], ' ') else ss[j] end
      when length(cur) + length(ps[i]) <= 500 then case when cur = '' then ps[i] else cur || chr(10) || chr(10) || ps[i] end
      when cur <> '' then regexp_replace(right(cur, 100), '^[\s\x{A0}\x{3000}]+', '') || chr(10) || chr(10) || ps[i]
      else cur end,
    case when j > 0 then case when length(cur) + length(ss[j]) > 500 and cur <> '' then cur end when length(cur) + length(ps[i]) > 500 and cur <> '' then cur end
  from fold where i <= len(ps)
), steps as (
  select doc_id, i, j, out, cur, i > len(ps) as last from fold
), emitted as (
  select doc_id, i, case when j = 0 then 1000000 else j end as j, 0 as z, out from steps where out is not null union all select doc_id, i, 2000000, 1, cur from steps where last and cur <> ''
)
select doc_id as source, row_number() over (partition by doc_id order by i, j, z) - 1 as chunk_id, out as text from emitted""",
    "heuristic_elements": r"""with listed as (
  select doc_id, 1 as step, v.k, v.v as size, null as material, null as designation, v.v as item from documents, (values (1, 'ertion'), (2, 'thnd')) as v(k, v) where contains(lower(text), v.v)
), named as (
  select doc_id, 3, m.k, null, m.v, null, 'мат-' || m.v from documents, (values (1, 'stand'), (2, 'keit'), (3, 'mentre')) as m(k, v) where contains(text, m.v)
), marks as (
  select doc_id, d, min(k) as k from (select doc_id, unnest(ds) as d, generate_subscripts(ds, 1) as k from (select doc_id, regexp_extract_all(text, 'oning[a-z]{1,3}') as ds from documents)) group by all
), every as (select * from listed union all select * from named union all select doc_id, 4, k, null, null, d, d from marks)
select doc_id, row_number() over (partition by doc_id order by step, k) - 1 as pos, 'эвристика:' || item as item_id, size, material, designation from every""",
    "parsed_replies": """with k as (
  select event_id, event_type, json_extract(props, '$.k')::int as k from events
), r as (
  select *, case when k % 7 = 0 then 'none' when k % 11 = 0 then 'none' else 'ok' end as state, k % 5 <> 0 as typed from k
), e as (
  select *, case when state <> 'ok' then 0 when typed then 2 else 1 end as n, case when state = 'ok' and k % 4 = 0 then true when state = 'ok' and k % 4 = 1 then false end as c, case when state = 'ok' and typed and k % 3 = 0 then 1 else 0 end as low from r
)
select event_id, n as n_elements, case when n = 2 then k::varchar end as size, case n when 2 then case when k % 3 = 0 then 'low' else 'medium' end when 1 then 'medium' end as confidence, case when n > 0 then 'pdf_text' end as source,
  c as is_compliant, case when state = 'ok' then event_type || ',x' else 'LLM не вернул валидный JSON — результат ненадёжен' end as missing, case when state = 'ok' then 'c' else '' end as citations,
  case when n = 0 or low > n // 2 then 'low' when low > 0 or c is null then 'medium' else 'high' end as overall_confidence from e""",
    "labelled_buckets": """with d as (
  select source, doc_id, quality = 1 as c from documents left join labels using (doc_id)
), a as (
  select source, count(*) as total_drawings, list(doc_id order by doc_id) filter (where c) as yes, count(*) filter (where not c) as n_no, count(*) filter (where c is null) as n_open from d group by 1
)
select source, total_drawings, coalesce(len(yes), 0) as n_compliant, n_no as n_non_compliant, n_open as n_undetermined,
  coalesce(array_to_string(list_transform(yes[1:8], lambda x: x::varchar), ','), '') || case when len(yes) > 8 then ',… ещё ' || (len(yes) - 8) else '' end as first_compliant from a""",
    "drawing_pages": "select user_id as doc_id, count(*) as total_pages, count(*) filter (where event_type = 'click') as pages_with_drawings from events group by 1",
    "match_texts": r"""with m as (select doc_id, regexp_replace(translate(text, chr(160) || '×xX', ' ххх'), '[\s\x{A0}\x{3000}]+', ' ', 'g') as t from documents)
select doc_id, length(t) as n, md5(t) as text_md5 from m""",
    "support_texts": r"""with f as (select doc_id, trim(regexp_replace(lower(text), '[\s\x{A0}\x{3000}]+', ' ', 'g')) as t from documents)
select doc_id, regexp_matches(t, '\d{2,4}\s*[xх×]\s*\d{2,4}|\d+\s*[=≈]\s*\d+|масштаб\s*1\s*[:]') or contains(t, 'примечани') or contains(t, 'условн') or contains(t, 'размер') or contains(t, 'экспликац') or contains(t, 'легенда') as supported from f""",
    "page_texts": r"""with r as (
  select doc_id, upper(lang) as ocr, case when lang = 'en' then repeat('Двухэтажный жилой дом из кирпича с гаражом и мансардой, вариант первый, стены и план этажа. ', 3) else '' end || text as raw from documents
), s as (select *, regexp_replace(raw, '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g') as t from r
), c as (
  select *, len(regexp_extract_all(t, '[\x{0400}-\x{04FF}]')) as cyrillic, len(regexp_extract_all(t, '[A-Za-z]')) as latin, len(regexp_extract_all(raw, '[\p{L}\p{M}\p{N}_]')) as letters,
    regexp_matches(lower(t), 'жилой|дом|мансард|этажн|гараж|арболит|брус|кирпич|одноэтаж|двухэтаж|вариант|стен') as hinted from s
), n as (
  select *, length(t) < 100 or contains(raw, chr(65533)) or (letters > 20 and cyrillic < 0.15 * letters) or (cyrillic < 5 and latin >= 25) or (not hinted and cyrillic < case when length(t) >= 120 then 20 else 12 end) as needed from c
)
select doc_id, needed, md5(case when needed and ocr <> '' then raw || chr(10) || ocr else raw end) as text_md5 from n""",
    "project_names": """with t as (
  select p_partkey, p_size, case p_size % 3 when 0 then 'кирпич' when 1 then 'Арболит и брус' else 'стены: монолит' end as material, case p_size % 3 when 0 then 'kirpich' when 1 then 'arbolit' else 'стены_монолит' end as word from part
)
select p_partkey, 'ЖИЛОЙ ДОМ (' || p_size || ',5 х 12.0) (' || material || ')' as signature, 'project_zhdom_' || p_size || '_5x12_0_' || word as slug from t""",
    "sheet_labels": """select p_partkey, case p_size % 4 when 0 then p_partkey || '_' || '_' || '_' || replace(p_name, ' ', '_') when 1 then 'план_этажа_' || p_partkey when 2 then p_size || '-AB7' else replace(p_name, ' ', '_') || '__' || p_partkey end as label from part""",
    "rules_sentences": """with h as (select '=== Машиночитаемые правила ТЗ ===' as head, 'Поле ''bolt_size'' (): допустимые значения: M8, M10. Единица: . Стандарт: S1. Ссылка: 1.' || chr(10) || 'Поле ''wall'' (): диапазон 4.0–46.0 mm. Стандарт: S2. Ссылка: 2.' || chr(10) || 'Поле ''gap'' (): диапазон 1.0–40.0 mm. Стандарт: S3. Ссылка: .' || chr(10)
  || 'Материалы: допустимые: STANDARD, MEDIUM, LARGE, SMALL. Запрещённые: PROMO. Стандарт: S4. Ссылка: 4.' || chr(10) || 'Обозначения: паттерн ''^Brand#[0-9]{2}$''. Примеры: Brand#10. Ссылка: 5.' || chr(10) || 'Покрытия: допустимые коды: bolt, ring. Стандарт: S6. Ссылка: 6.' as body
), c as (select head || chr(10) || chr(10) || body as text, 0 as chunk_id from h where length(head) + length(body) <= 500 union all select unnest([head, head || chr(10) || chr(10) || body]), unnest([0, 1]) from h where length(head) + length(body) > 500)
select 'rules.json#00000' || chunk_id as id, chunk_id, length(text) as n, text from c""",
    "album_drawings": rf"""with {_PAGES}, ranked as (
  select *, list_reverse_sort([drawing, explication, annotation, ad]) as s from scored
), best as (
  select *, case when s[1] >= 0.52 and s[1] - s[2] >= 0.12 then s[1] end as b, trim(regexp_replace(raw, '[\s\x{{A0}}\x{{3000}}]+', ' ', 'g')) as flat from ranked
), named as (
  select *, coalesce(nullif(replace(regexp_extract(flat, '\b(\d{{1,4}}\s*[-–—]\s*[А-ЯA-ZЁё0-9]{{1,8}})\b', 1), ' ', ''), ''), left(flat, 64)) as name from best
), stemmed as (
  select *, regexp_replace(trim(regexp_replace(name, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '\s+', '_', 'g') as clean from named
), flags as (
  select doc_id as page, not ads and coalesce(drawing = b, false) as is_drawing, not ads and (coalesce(explication = b, false) or coalesce(annotation = b, false) or (proj and (b is null or annotation = b))) as content, ads or coalesce(ad = b, false) as is_ad,
    (regexp_matches(left(t, 1800), 'the\s*an') and (contains(left(t, 1800), 'tion') or contains(left(t, 1800), 'keit'))) or contains(left(t, 1800), 'thouin') or contains(left(t, 1800), 'ondre') as starts,
    case when flat = '' then 'drawing' else coalesce(nullif(rtrim(left(coalesce(nullif(trim(clean, '._'), ''), 'drawing'), 72), '._'), ''), 'drawing') end as label from stemmed
), album as (
  select source as doc_id, f.*, row_number() over (partition by source order by page) as place from flags f join documents d on d.doc_id = f.page
), segmented as (
  select *, 1 + sum((starts and place > 1)::int) over (partition by doc_id order by page) as segment from album
), zoned as (
  select *, sum(is_ad::int) over (partition by doc_id, segment order by page) as zone from segmented
), bounds as (
  select *, min(place) over z as zone_first, max(place) over z as zone_last from zoned where not is_ad window z as (partition by doc_id, segment, zone)
), steps as (
  select *, coalesce(place - lag(place) over (partition by doc_id, segment, zone order by place) - 1 > 3, true) as new from bounds where is_drawing or content
), islands as (
  select *, sum(new::int) over (partition by doc_id, segment, zone order by place) as run from steps
), runs as (
  select doc_id, segment, zone, run, zone_first, zone_last, min(place) as lo, max(place) as hi, bool_or(is_drawing) as drawn from islands group by all
), glued as (
  select doc_id, segment, zone, run, drawn, case when run = 1 and lo - zone_first <= 2 then zone_first else lo end as low,
    case when run = max(run) over (partition by doc_id, segment, zone) and zone_last - hi <= 2 then zone_last else hi end as high from runs
), paged as (
  select g.doc_id, g.segment, g.zone, run, place, page, is_drawing, label, floor((row_number() over (partition by g.doc_id, g.segment, g.zone, run order by place) - 1) / 48)::int as part
  from glued g join zoned z on g.doc_id = z.doc_id and g.segment = z.segment and g.zone = z.zone and place between low and high and not is_ad where drawn
), files as (
  select doc_id, segment, zone, run, part, min(page) as first_page, max(page) as last_page, count(*) as n_pages, coalesce(arg_min(label, place) filter (where is_drawing), arg_min(label, place)) as label from paged group by all
), numbered as (
  select *, min(first_page) over w as run_first, row_number() over (partition by doc_id order by first_page) as seq, count(*) over w > 1 as cut from files window w as (partition by doc_id, segment, zone, run)
), based as (
  select *, printf('drawing_p%02d_', segment::int) || label || case when cut then printf('_p%03d', seq::int) else '' end as base from numbered
)
select doc_id, seq, segment, run_first, first_page, last_page, n_pages,
  base || case when row_number() over (partition by doc_id, base order by seq) > 1 then '_' || (row_number() over (partition by doc_id, base order by seq) - 1) else '' end as stem from based""",
    "joined_pages": """with p as (
  select conv_id as doc_id, turn as page_number, case when role = 'assistant' then '# ' || text else text end as pdf, case when role = 'user' then lower(text) end as ocr, case when turn = 3 then 'a drawing' end as caption from conversations
), q as (
  select *, case when trim(pdf) <> '' then '[PDF стр.' || page_number || ']' || chr(10) || pdf end as a, case when trim(ocr) <> '' then '[OCR стр.' || page_number || ' (easyocr)]' || chr(10) || ocr end as b, case when caption is not null then '[LLaVA стр.' || page_number || ']' || chr(10) || caption end as c from p
)
select doc_id, page_number, (a is not null)::int + (b is not null)::int + (c is not null)::int as n_parts, md5(concat_ws('|', a, b, c)) as parts_md5, md5(to_base64(encode(pdf))) as image_md5, doc_id || '-стр.' || page_number as sheet_id from q""",
    "drawing_reports": f"""with {_BY_TALK}
select drawing_id, n_elements, n_issues, n_missing, is_compliant, overall_confidence, asked as llm_used, chunks_md5,
  'Чертёж ' || drawing_id || ': ' || case when is_compliant then 'СООТВЕТСТВУЕТ' when not is_compliant then 'НЕ СООТВЕТСТВУЕТ' else 'НЕЛЬЗЯ ОПРЕДЕЛИТЬ' end || ' | Элементов: ' || n_elements || ' | Расхождений: ' || n_issues || ' | Не определено: ' || n_missing as summary from reported""",
    "page_batches": f"""with {_BY_TURN}, placed as (select r.*, t.turn from reported r join turns t using (drawing_id))
select base as base_drawing_id, base || '.pdf' as pdf_path, count(*) as total_drawings, sum(n_elements) as n_elements, coalesce(string_agg(case when is_compliant then drawing_id end, ',' order by turn), '') as compliant,
  coalesce(string_agg(case when not is_compliant then drawing_id end, ',' order by turn), '') as non_compliant, coalesce(string_agg(case when is_compliant is null then drawing_id end, ',' order by turn), '') as undetermined from placed group by base""",
    "album_projects": f"""with {_BY_TALK}, c as (
  select role, conv_id, r.drawing_id, r.is_compliant, conv_id % 2 = 0 as held from conversations join reported r on r.drawing_id = 'c' || conv_id where turn = 0
)
select role as source_album, count(*) as n_split_boundaries, count(*) filter (where held and is_compliant) as n_compliant, count(*) filter (where held and not is_compliant) as n_non_compliant, count(*) filter (where held and is_compliant is null) as n_undetermined, count(*) filter (where held) as n_projects,
  arg_min(drawing_id, conv_id) filter (where held) as first_project, min(conv_id) filter (where held) * 8 + 8 as first_end, '/projects/' || role || '_pipeline_report.json' as pipeline_report_path from c group by 1""",
    "prompt_texts": f"""with {_BY_TALK}, p as (select drawing_id, drawing_id || chr(10) || left(text, 3000) || chr(10) || left(blocks, 2000) as prompt from reported)
select drawing_id, length(prompt) as n, md5(prompt) as prompt_md5 from p""",
}
