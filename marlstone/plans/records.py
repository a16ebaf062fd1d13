"""The whole document pipeline, and the operators that fill and keep records: each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import scan_result
from ..functions.text import cap_question, clean_title, front_matter_block, heading_line, image_context, meta_comment, question_prompt, size_kb, strip_citation, title_from_file
from ..functions.url import canonical, should_follow
from ..operators import evaluation, html, images, incremental, quality
from ..operators.chunking import document_chunks, first_wins
from ..operators.context import shown_sources
from ..operators.conversation import next_id
from ..operators.links import reference_links
from ..operators.numbering import number_rows
from ..operators.sections import headings
from ..operators.tables import has_table
from ..sources.files import image_names
from ..streaming.ingest import tumbling_counts
from . import documents, retrieval, scalar, tables
from .documents import CELLS, LINES, RUN_SQL, _meta
from .scalar import sql_strip, t

NL = "chr(10)"


def chunk_pipeline(spark, d):
    """Documents to deduplicated chunks, section indexes included."""
    chunks = document_chunks(t(spark, d, "documents"), "doc_id", "text", "doc_title", "source_url")
    return first_wins(chunks, "chunk_id", "doc_id", "ord")


def upsert_batches(spark, d):
    """What two loads leave: the rows of the month's first half, then the others."""
    rows = t(spark, d, "all_chunks").select("chunk_id", "loaded_at").where("chunk_id IS NOT NULL")
    early = F.coalesce(F.dayofmonth("loaded_at") <= 15, F.lit(True))
    return incremental.upsert(rows.where(early), rows.where(~early), "chunk_id", "loaded_at")


def row_numbers(spark, d):
    return number_rows(t(spark, d, "documents").select("doc_id"), "doc_id", "n")


def file_titles(spark, d):
    return t(spark, d, "doc_registry").select("output_file").distinct().select("output_file", title_from_file(F.col("output_file")).alias("title"))


def clean_titles(spark, d):
    shown = F.concat(F.lit("Copy of "), "doc_title", F.lit(" - Google Docs"))
    return t(spark, d, "all_chunks").where("doc_title IS NOT NULL").select(F.explode(F.array("doc_title", shown)).alias("shown")).distinct().select("shown", clean_title(F.col("shown")).alias("title"))


def heading_lines(spark, d):
    rows = t(spark, d, "all_chunks").where("heading IS NOT NULL AND heading_level IS NOT NULL").select("heading_level", "heading", "section").distinct()
    number = F.regexp_extract(F.coalesce("section", F.lit("")), r"^([0-9]+(?:\.[0-9]+)*)", 1)
    return rows.select("heading_level", "heading", "section", heading_line(F.col("heading_level"), F.col("heading"), number).alias("line"))


def table_flags(spark, d):
    return t(spark, d, "documents").select("doc_id", has_table(F.col("text")).alias("has_table"))


def front_matter_blocks(spark, d):
    c = lambda x: F.coalesce(x, F.lit(""))
    return t(spark, d, "doc_registry").distinct().select("url", F.md5(front_matter_block(c("title"), c("url"), c("parent"), c("scraped_at"))).alias("hash"))


def meta_comments(spark, d):
    c = lambda x: F.coalesce(x, F.lit(""))
    rows = t(spark, d, "all_chunks").select("chunk_id", "doc_title", "section", "breadcrumb", "source_url").distinct()
    return rows.select("chunk_id", F.md5(meta_comment(c("doc_title"), c("section"), c("breadcrumb"), c("source_url"))).alias("hash"))


def scan_results(spark, d):
    rows = t(spark, d, "image_metadata").select("filename", "image_content", "scan_error", "file_size_kb").distinct()
    none = F.lit(None).cast("int")
    r = scan_result(F.col("image_content"), F.col("scan_error"), F.col("file_size_kb") * 1024, none, none)
    return rows.select("filename", r.alias("r")).select("filename", "r.*").distinct()


def image_contexts(spark, d):
    rows = t(spark, d, "image_metadata").select("filename", "surrounding_before", "surrounding_after").distinct()
    return rows.select("filename", F.md5(image_context(F.col("filename"), F.col("surrounding_before"), F.col("surrounding_after"))).alias("hash"))


def question_prompts(spark, d):
    rows = t(spark, d, "all_chunks").where("content IS NOT NULL").select("chunk_id", "content", "section").distinct()
    return rows.select("chunk_id", F.md5(question_prompt(F.col("content"), F.col("section"))).alias("hash"))


def question_runs(spark, d):
    return quality.question_run_stats(t(spark, d, "all_chunks"), "hyde_questions")


def next_ids(spark, d):
    return next_id(t(spark, d, "doc_registry"), "parent", "toc_entries")


def image_files(spark, d):
    rows = t(spark, d, "image_metadata").where("filename IS NOT NULL").select("filename", F.coalesce("image_content", F.lit("")).alias("content"), F.regexp_extract("filename", r"\.([a-z]+)$", 1).alias("extension"))
    return image_names(rows, "filename", "extension").select("filename", "file", "image_hash")


def numbered_headings(spark, d):
    """Every heading with the place of its title among the first-level headings of its document."""
    hs = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(headings(F.col("text"))).alias("i", "h")).select("doc_id", "i", F.col("h.level").alias("level"), F.col("h.title").alias("title"))
    toc = hs.where("level = 1").groupBy("doc_id", F.col("title").alias("anchor")).agg(F.min("i").cast("string").alias("number"))
    return html.number_headings(hs, toc, "title", "doc_id").select("doc_id", "i", "level", "title", "number")


def eval_report(spark, d):
    return evaluation.scores(evaluation.checks(tables._answers(spark, d))).select("grouping", "chunk_type", "topic", "passed_percent", "sourced_percent")


def eval_failures(spark, d):
    out = evaluation.failures(evaluation.checks(tables._answers(spark, d)))
    return out.select("id", F.array_join("missing", "; ").alias("missing"))


def follow_links(spark, d):
    urls = t(spark, d, "reference_links").select("url").union(t(spark, d, "doc_registry").select("url")).union(t(spark, d, "restricted_links").select("url")).distinct()
    return urls.select("url", should_follow(canonical(F.col("url"))).alias("follow"))


def questions_todo(spark, d):
    return incremental.questions_todo(t(spark, d, "all_chunks")).select("chunk_id").distinct()


def scans_todo(spark, d):
    return incremental.scans_todo(t(spark, d, "image_metadata")).select("filename").distinct()


def refresh_due(spark, d):
    return incremental.due_for_refresh(t(spark, d, "documents"), "scraped_at", F.lit("2031-12-31").cast("date")).select("doc_id")


def capped_texts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(cap_question(strip_citation(F.col("text")))).alias("hash"))


def text_sizes(spark, d):
    return t(spark, d, "documents").select("doc_id", size_kb(F.encode("text", "UTF-8")).alias("kb"))


def shown_source_rows(spark, d):
    return shown_sources(retrieval.context_sources(spark, d))


def _picture_pages(spark, d):
    """One page per picture: a menu to be skipped, a heading, a paragraph, the picture in a paragraph of its own, a paragraph."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = t(spark, d, "image_metadata").where("filename IS NOT NULL").select("filename", "section", "surrounding_before", "surrounding_after").distinct()
    page = F.concat(
        F.lit('<div id="banners"><div>Menu</div><img src="https://x.example/logo.png"></div><h1>'), safe("section"), F.lit("</h1><p>"), safe("surrounding_before"),
        F.lit('</p><p><img alt="p" src="data:image/png;base64,'), F.base64(F.encode("filename", "UTF-8")), F.lit('">caption</p><p>'), safe("surrounding_after"), F.lit("</p>"),
    )
    return html.extract(rows.select("filename", page.alias("h")), "filename", "h")


def page_pictures(spark, d):
    rows = images.page_images(_picture_pages(spark, d), "filename")
    return rows.select("filename", "pos", F.md5(F.concat_ws("|", "section", "before", "after")).alias("hash"))


def picture_records(spark, d):
    rows = images.fetch_images(images.page_images(_picture_pages(spark, d), "filename"), "src")
    return images.image_records(rows, "filename").select(F.col("filename").alias("file"), "file_size_kb", "image_hash")


def collected_links(spark, d):
    """External links of pages built from the records of links, first place first."""
    rows = t(spark, d, "reference_links").where("url IS NOT NULL AND found_in_doc IS NOT NULL").select("found_in_doc", "url").distinct()
    anchors = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<p><a href="'), "url", F.lit('">link</a></p>')))), "")
    pages = html.extract(rows.groupBy("found_in_doc").agg(anchors.alias("h")), "found_in_doc", "h")
    return reference_links(pages, "found_in_doc").select("url", "found_in", F.size("also_found_in").alias("others"))


def event_tumbling(spark, d):
    """Extension: events per hour and type, by the operator that streams run with a watermark."""
    return tumbling_counts(t(spark, d, "events"), "ts", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_pipeline, upsert_batches, row_numbers, file_titles, clean_titles, heading_lines, table_flags, front_matter_blocks, meta_comments, scan_results, image_contexts, question_prompts, question_runs,
        next_ids, image_files, numbered_headings, eval_report, eval_failures, follow_links, questions_todo, scans_todo, refresh_due, capped_texts, text_sizes, shown_source_rows, page_pictures, picture_records,
        collected_links, event_tumbling,
    )
}

_FM = "regexp_extract(text, '(?s)\\A---\\n(.*?)\\n---', 1)"


def _front(key: str) -> str:
    """Value of a front-matter key, '' without one."""
    return sql_strip(f"coalesce(list_last(regexp_extract_all({_FM}, '(?m)^{key}:([^\\n]*)', 1)), '')")


_TITLED = f"dd AS (SELECT doc_id, text, coalesce(nullif({_front('doc_title')}, ''), doc_title, '') AS doc_title, coalesce(nullif({_front('source_url')}, ''), source_url, '') AS source_url, nullif({_front('parent_doc')}, '') AS parent FROM documents WHERE text IS NOT NULL)"
_CELL_ROWS = CELLS.replace("{0}", "part")
_LINEAR = f"array_to_string(list_concat([array_to_string(rs[1], ' | ')], list_transform(rs[2:], lambda r: array_to_string(list_transform(r, lambda v, i: CASE WHEN i <= len(rs[1]) THEN rs[1][i] || ': ' || v ELSE v END), ', '))), {NL})"
_HEADS = documents.HEADS.replace("FROM documents WHERE text IS NOT NULL", "FROM dd").replace("coalesce(doc_title, '') AS title", "doc_title AS title")
_PIPELINE = f"""WITH RECURSIVE {_TITLED}, {LINES.replace("FROM documents WHERE text IS NOT NULL", "FROM dd")},
    x AS (SELECT b.doc_id, b.sec, b.level, b.heading, b.content, coalesce({_meta('doc')}, b.title) AS cdoc, coalesce({_meta('section')}, b.heading) AS section, coalesce({_meta('breadcrumb')}, b.title || ' > ' || b.heading) AS breadcrumb, coalesce({_meta('url')}, b.durl) AS curl,
        CASE WHEN contains(b.content, '[IMAGE:') THEN 'image' WHEN contains(b.content, '|---') OR (length(b.content) - length(replace(b.content, '|', '')) >= 4 AND contains(b.content, {NL} || '|')) THEN 'table' WHEN length(b.content) // 4 <= 512 THEN 'whole' ELSE 'packed' END AS way
        FROM b LEFT JOIN b p ON p.doc_id = b.doc_id AND p.sec = b.sec - 1 WHERE b.sec > 0 AND b.content <> '' AND b.heading <> ''),
    p1 AS (SELECT doc_id, sec, 0::BIGINT AS part_no, 'text' AS kind, CASE WHEN way = 'image' THEN {sql_strip("regexp_replace(content, '(?s)[[]IMAGE:[^]]+[]].*$', '')")} ELSE content END AS part FROM x WHERE way IN ('image', 'whole')),
    ta AS (SELECT doc_id, sec, string_split_regex(content, '\\n\\|[^\\n]+\\|(?:\\n\\|[^\\n]+\\|)*') AS ts, regexp_extract_all(content, {RUN_SQL}, 1) AS tabs FROM x WHERE way = 'table'),
    tb AS (SELECT doc_id, sec, list_filter(flatten(list_transform(ts, lambda q, i: [{sql_strip('q')}, {sql_strip("coalesce(tabs[i], '')")}])), lambda q: q <> '') AS ps FROM ta),
    tc AS (SELECT doc_id, sec, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS part_no FROM tb),
    td AS (SELECT *, starts_with(part, '|') OR contains(part, '|---') AS is_table, {_CELL_ROWS} AS rs FROM tc),
    p2 AS (SELECT doc_id, sec, part_no, CASE WHEN is_table THEN 'table' ELSE 'text' END AS kind, CASE WHEN is_table AND len(rs) > 0 THEN {_LINEAR} ELSE part END AS part FROM td),
    ka AS (SELECT doc_id, sec, list_filter(list_transform(string_split_regex(content, '\\n\\n+'), lambda q: {sql_strip('q')}), lambda q: q <> '') AS ps FROM x WHERE way = 'packed'),
    kb AS (SELECT doc_id, sec, unnest(ps) AS q, generate_subscripts(ps, 1) AS n FROM ka),
    kc AS (SELECT doc_id, sec, n, q, 0 AS batch, length(q) // 4 AS tok FROM kb WHERE n = 1 UNION ALL SELECT kb.doc_id, kb.sec, kb.n, kb.q, CASE WHEN kc.tok + length(kb.q) // 4 > 512 THEN kc.batch + 1 ELSE kc.batch END, CASE WHEN kc.tok + length(kb.q) // 4 > 512 THEN length(kb.q) // 4 ELSE kc.tok + length(kb.q) // 4 END FROM kc JOIN kb ON kb.doc_id = kc.doc_id AND kb.sec = kc.sec AND kb.n = kc.n + 1),
    p3 AS (SELECT doc_id, sec, batch::BIGINT AS part_no, 'text' AS kind, string_agg(q, {NL} || {NL} ORDER BY n) AS part FROM kc GROUP BY doc_id, sec, batch),
    parts AS (SELECT doc_id, sec, part_no, kind, {sql_strip('part')} AS content FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)),
    {_HEADS},
    every AS (SELECT x.doc_id, x.sec::BIGINT * 4294967296 + part_no + 1 AS ord, kind AS chunk_type, parts.content, heading, x.level::INT AS heading_level, cdoc AS doc_title, section, breadcrumb, curl AS source_url, coalesce(dd.parent, dd.doc_title) AS parent_doc
        FROM parts JOIN x USING (doc_id, sec) JOIN dd ON dd.doc_id = x.doc_id WHERE parts.content <> '' AND length(parts.content) // 4 >= 50
        UNION ALL SELECT dd.doc_id, 0, 'section_index', '# Section Index: ' || title || {NL} || {NL} || array_to_string(list_transform(hs, lambda h: repeat('  ', h.level - 1) || '- ' || h.title), {NL}), 'Section Index: ' || dd.doc_title, 1, dd.doc_title, 'Section Index', dd.doc_title, dd.source_url, coalesce(dd.parent, dd.doc_title)
        FROM hh JOIN dd ON dd.doc_id = hh.doc_id WHERE len(hs) > 0)
    SELECT doc_id, ord, substr(md5(content), 1, 12) AS chunk_id, chunk_type, content, concat_ws('. ', nullif(heading, ''), nullif(breadcrumb, ''), nullif(CASE WHEN chunk_type = 'table' THEN substr(content, 1, 200) ELSE content END, '')) AS embed_text, heading, heading_level, doc_title, section, breadcrumb, source_url, parent_doc, (length(content) // 4)::INT AS token_count
    FROM every QUALIFY row_number() OVER (PARTITION BY substr(md5(content), 1, 12) ORDER BY doc_id, ord) = 1"""

_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_flat = lambda c, n=0: (f"substr({{}}, 1, {n})" if n else "{}").format(f"trim(regexp_replace(coalesce({c}, ''), '{_SPACE}+', ' ', 'g'))")
_PICTURES = "(SELECT DISTINCT filename, section, surrounding_before, surrounding_after FROM image_metadata WHERE filename IS NOT NULL)"
_CLASSES = scalar.ORACLES["image_classes"]
_CLASS = _CLASSES[_CLASSES.index("CASE WHEN") : _CLASSES.index(" END AS class") + 4]
_CHECKS = tables.ORACLES["eval_scores"]
_CHECKS = _CHECKS[: _CHECKS.index("SELECT CASE WHEN grouping(chunk_type)")]

ORACLES = {
    "chunk_pipeline": _PIPELINE,
    "upsert_batches": "SELECT chunk_id, max(loaded_at) AS loaded_at FROM all_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id",
    "row_numbers": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents",
    "file_titles": "SELECT DISTINCT output_file, array_to_string(list_transform(string_split(replace(regexp_replace(output_file, '\\.[^.]*$', ''), '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM doc_registry",
    "clean_titles": f"WITH s AS (SELECT DISTINCT unnest([doc_title, 'Copy of ' || doc_title || ' - Google Docs']) AS shown FROM all_chunks WHERE doc_title IS NOT NULL) SELECT shown, {sql_strip(chr(39).join(['regexp_replace(CASE WHEN contains(shown, ', 'Google Docs', ') THEN regexp_replace(shown, ', '(?s)[ ]*-[ ]*Google Docs.*$', ', ', '', ') ELSE shown END, ', '^Copy of ', ', ', '', ')']))} AS title FROM s",
    "heading_lines": "WITH h AS (SELECT DISTINCT heading_level, heading, section, regexp_extract(coalesce(section, ''), '^([0-9]+(?:\\.[0-9]+)*)', 1) AS no FROM all_chunks WHERE heading IS NOT NULL AND heading_level IS NOT NULL) SELECT heading_level, heading, section, repeat('#', heading_level) || ' ' || CASE WHEN no = '' OR contains(heading, no) THEN heading ELSE no || ' ' || heading END AS line FROM h",
    "table_flags": f"SELECT doc_id, contains(text, '|---') OR (length(text) - length(replace(text, '|', '')) >= 4 AND contains(text, {NL} || '|')) AS has_table FROM documents",
    "front_matter_blocks": f"SELECT DISTINCT url, md5('---' || {NL} || 'doc_title: ' || coalesce(title, '') || {NL} || 'source_url: ' || coalesce(url, '') || {NL} || 'parent_doc: ' || coalesce(parent, '') || {NL} || 'scraped_at: ' || coalesce(scraped_at, '') || {NL} || '---' || {NL}) AS hash FROM (SELECT DISTINCT * FROM doc_registry)",
    "meta_comments": "SELECT chunk_id, md5('<!-- meta | doc:' || coalesce(doc_title, '') || ' | section:' || coalesce(section, '') || ' | breadcrumb:' || coalesce(breadcrumb, '') || ' | url:' || coalesce(source_url, '') || ' -->') AS hash FROM (SELECT DISTINCT chunk_id, doc_title, section, breadcrumb, source_url FROM all_chunks)",
    "scan_results": f"""WITH c AS (SELECT DISTINCT filename, scan_error, file_size_kb, {_CLASS} AS class FROM (SELECT *, coalesce(image_content, '') AS x FROM image_metadata))
        SELECT DISTINCT filename, CASE WHEN file_size_kb * 1024 < 500 THEN 'image_empty' WHEN scan_error IS NOT NULL THEN 'image_text' ELSE class END AS chunk_type, CASE WHEN file_size_kb * 1024 < 500 THEN true WHEN scan_error IS NOT NULL THEN false ELSE class = 'image_empty' END AS is_decorative, CASE WHEN file_size_kb * 1024 < 500 THEN 'size' WHEN scan_error IS NOT NULL THEN 'fallback' ELSE 'ocr' END AS scan_method FROM c""",
    "image_contexts": f"SELECT filename, md5('[IMAGE:' || filename || ']' || {NL} || 'Context before: ' || coalesce(surrounding_before, '') || {NL} || 'Context after: ' || coalesce(surrounding_after, '')) AS hash FROM (SELECT DISTINCT filename, surrounding_before, surrounding_after FROM image_metadata)",
    "question_prompts": f"SELECT chunk_id, CASE WHEN length(c) >= 50 THEN md5('Write three questions that this text answers.' || {NL} || 'Section: ' || coalesce(section, '') || {NL} || {NL} || substr(c, 1, 1500)) END AS hash FROM (SELECT DISTINCT chunk_id, section, content, {sql_strip('content')} AS c FROM all_chunks WHERE content IS NOT NULL)",
    "question_runs": "SELECT count(*) FILTER (len(hyde_questions) > 0) AS generated, count(*) FILTER (coalesce(len(hyde_questions), 0) = 0) AS failed, coalesce(sum(len(hyde_questions)), 0)::BIGINT AS total_questions FROM all_chunks",
    "next_ids": "SELECT parent, coalesce(max(toc_entries), 0) + 1 AS next_id FROM doc_registry GROUP BY parent",
    "image_files": "WITH k AS (SELECT filename, md5(coalesce(image_content, '')) AS image_hash FROM image_metadata WHERE filename IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(coalesce(image_content, '')) ORDER BY filename) = 1) SELECT filename, image_hash, 'img_' || lpad((row_number() OVER (ORDER BY filename))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY filename))::VARCHAR))::INT, '0') || '.' || regexp_extract(filename, '\\.([a-z]+)$', 1) AS file FROM k",
    "numbered_headings": f"WITH {documents.HEADS}, h AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS i FROM hh), c AS (SELECT doc_id, h.title AS title, min(i)::VARCHAR AS number FROM h WHERE h.level = 1 GROUP BY ALL) SELECT h.doc_id, h.i::INT AS i, h.h.level::INT AS level, h.h.title AS title, c.number FROM h LEFT JOIN c ON c.doc_id = h.doc_id AND c.title = h.h.title",
    "eval_report": f"{_CHECKS} SELECT CASE WHEN grouping(chunk_type) = 0 THEN 'chunk_type' WHEN grouping(topic) = 0 THEN 'topic' ELSE 'all' END AS \"grouping\", chunk_type, topic, round(100.0 * count(*) FILTER (answer_pass) / count(*), 1)::DOUBLE AS passed_percent, round(100.0 * count(*) FILTER (source_pass) / count(*), 1)::DOUBLE AS sourced_percent FROM cc GROUP BY GROUPING SETS ((chunk_type), (topic), ())",
    "eval_failures": f"{_CHECKS} SELECT cc.id, array_to_string(list_filter(e.expected_keywords, lambda k: NOT contains(lower(coalesce(an.answer, '')), lower(k)))[1:3], '; ') AS missing FROM cc JOIN eval_questions e ON e.id = cc.id LEFT JOIN an ON an.id = cc.id WHERE NOT coalesce(cc.answer_pass, false) ORDER BY cc.id LIMIT 5",
    "follow_links": "WITH u AS (SELECT url FROM reference_links UNION SELECT url FROM doc_registry UNION SELECT url FROM restricted_links) SELECT url, coalesce(url <> '' AND NOT starts_with(url, '#') AND NOT regexp_matches(url, 'facebook[.]com|twitter[.]com|instagram[.]com') AND contains(url, '/document/d/'), false) AS follow FROM u",
    "questions_todo": "SELECT DISTINCT chunk_id FROM all_chunks WHERE (chunk_type IS NULL OR chunk_type NOT IN ('section_index', 'restricted_doc')) AND coalesce(len(hyde_questions), 0) = 0",
    "scans_todo": "SELECT DISTINCT filename FROM image_metadata WHERE coalesce(needs_ocr, true)",
    "refresh_due": "SELECT doc_id FROM documents WHERE scraped_at IS NULL OR scraped_at::DATE <= DATE '2031-12-31' - 91",
    "capped_texts": "SELECT doc_id, md5(substr(regexp_replace(text, '(?s)\\n*📎.*$', ''), 1, 500)) AS hash FROM documents",
    "text_sizes": "SELECT doc_id, round(strlen(text) / 1024.0, 2)::DOUBLE AS kb FROM documents",
    "shown_source_rows": f"SELECT * FROM ({retrieval.ORACLES['context_sources']}) WHERE coalesce(url, '') <> ''",
    "page_pictures": f"SELECT filename, 0 AS pos, md5(concat_ws('|', {_flat('section')}, {_flat('surrounding_before', 150)}, {_flat('surrounding_after', 200)})) AS hash FROM {_PICTURES}",
    "picture_records": "WITH k AS (SELECT DISTINCT filename FROM image_metadata WHERE filename IS NOT NULL), n AS (SELECT filename, row_number() OVER (ORDER BY filename) AS n FROM k) SELECT 'img_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') || '.png' AS file, round(strlen(filename) / 1024.0, 2)::DOUBLE AS file_size_kb, md5(filename) AS image_hash FROM n",
    "collected_links": "WITH c AS (SELECT DISTINCT found_in_doc, rtrim(regexp_replace(regexp_replace(split_part(url, '#', 1), '/u/\\d+/', '/', 'g'), '/(edit|view|copy)(\\?[^\\n]*)?$', ''), '/') AS url FROM reference_links WHERE url IS NOT NULL AND found_in_doc IS NOT NULL) SELECT url, min(found_in_doc) AS found_in, (count(*) - 1)::INT AS others FROM c WHERE starts_with(url, 'http') AND NOT contains(url, '/document/d/') AND NOT regexp_matches(url, 'facebook[.]com|twitter[.]com|instagram[.]com') GROUP BY url",
    "event_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
