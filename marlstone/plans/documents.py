"""Sections, breadcrumbs, tables, packing and chunks of markdown documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_count
from ..operators.chunking import detect_references, first_wins, image_chunks, link_chunks, pack_paragraphs, restricted_chunks, union_chunks
from ..operators.sections import breadcrumbs as breadcrumb_paths
from ..operators.sections import headings, split_sections, with_metadata
from ..operators.sections import section_index as index_text
from ..operators.tables import RUN, linearise, split_tables
from .scalar import sql_strip, t


def _docs(spark, d):
    return t(spark, d, "documents").where("text IS NOT NULL")


def section_split(spark, d):
    s = split_sections(_docs(spark, d), "doc_id", "text")
    return s.select("doc_id", "section_no", "level", "heading", F.length("content").alias("n"), F.md5("content").alias("hash"))


def meta_carry(spark, d):
    docs = _docs(spark, d).select(F.struct("doc_id", F.coalesce("doc_title", F.lit("")).alias("title"), F.coalesce("source_url", F.lit("")).alias("url")).alias("k"), "text")
    s = split_sections(docs, "k", "text").select("k.*", "section_no", "heading", "meta")
    return with_metadata(s, F.col("title"), F.col("url")).select("doc_id", "section_no", F.col("chunk_doc").alias("doc"), "section", "breadcrumb", F.col("chunk_url").alias("url"))


def breadcrumbs(spark, d):
    hs = headings(F.col("text"))
    rows = _docs(spark, d).select("doc_id", F.posexplode(breadcrumb_paths(hs, F.coalesce("doc_title", F.lit("")))).alias("i", "path"))
    return rows.select("doc_id", (F.col("i") + 1).alias("n"), "path")


def section_index(spark, d):
    return _docs(spark, d).select("doc_id", index_text(F.coalesce("doc_title", F.lit("")), headings(F.col("text"))).alias("content")).where("content IS NOT NULL")


def table_linearise(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(RUN), 1)).alias("i", "tab"))
    return rows.select("doc_id", (F.col("i") + 1).alias("n"), F.md5(linearise(F.col("tab"))).alias("hash"))


def table_split(spark, d):
    rows = _docs(spark, d).select("doc_id", F.inline(split_tables(F.col("text"))))
    return rows.groupBy("doc_id", "is_table").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("part")).cast("bigint").alias("chars"))


def packed_paragraphs(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(pack_paragraphs(F.col("text"), 512)).alias("i", "batch"))
    return rows.select("doc_id", (F.col("i") + 1).alias("batch_no"), token_count(F.col("batch")).alias("n_tokens"), F.md5("batch").alias("hash"))


def cross_references(spark, d):
    chunks = t(spark, d, "all_chunks").where("content IS NOT NULL").groupBy("chunk_id").agg(F.min("content").alias("content"))
    names = t(spark, d, "all_chunks").where("section IS NOT NULL").select("section")
    refs = detect_references(chunks, "chunk_id", "content", names, "section")
    return refs.select("chunk_id", F.array_join("references", "; ").alias("refs"))


def union_chunk_sources(spark, d):
    every = union_chunks(image=image_chunks(t(spark, d, "image_metadata")), reference_link=link_chunks(t(spark, d, "reference_links")), restricted_doc=restricted_chunks(t(spark, d, "restricted_links")))
    kept = first_wins(every, "chunk_id", "source_rank", "src", "content", "embed_text")
    return kept.select("chunk_id", "chunk_type", "source_rank", "token_count", F.md5("content").alias("content_hash"), F.md5("embed_text").alias("embed_hash"))


QUERIES = {f.__name__: f for f in (section_split, meta_carry, breadcrumbs, section_index, table_linearise, table_split, packed_paragraphs, cross_references, union_chunk_sources)}

LINES = """l AS (SELECT doc_id, coalesce(doc_title, '') AS title, coalesce(source_url, '') AS durl, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
    f AS (SELECT *, regexp_matches(line, '(?s)^#{1,4}[^\\S\\n].') AS h, regexp_matches(line, '^[^\\S\\n]*<!-- meta') AS m FROM l),
    s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM f),
    b AS (SELECT doc_id, any_value(title) AS title, any_value(durl) AS durl, sec, max(length(regexp_extract(line, '^(#{1,4})[^\\S\\n]', 1))) FILTER (h) AS level, max(""" + sql_strip("regexp_extract(line, '(?s)^#{1,4}[^\\S\\n]+(.*)$', 1)") + """) FILTER (h) AS heading,
          """ + sql_strip("string_agg(line, chr(10) ORDER BY pos) FILTER (NOT m)") + """ AS content, max_by(regexp_extract(line, '^[^\\S\\n]*(.*)$', 1), pos) FILTER (m) AS meta FROM s GROUP BY doc_id, sec)"""  # fmt: skip


def _meta(key: str) -> str:
    parts = "list_transform(string_split(regexp_replace(regexp_replace(p.meta, '<!--\\s*meta\\s*', '', 'g'), '\\s*-->', '', 'g'), '|'), lambda x: " + sql_strip("x") + ")"
    last = f"list_last(list_filter({parts}, lambda x: contains(x, ':') AND " + sql_strip("split_part(x, ':', 1)") + f" = '{key}'))"
    return sql_strip(f"substr({last}, instr({last}, ':') + 1)")


CELLS = "list_filter(list_transform(list_filter(list_transform(string_split({0}, chr(10)), lambda s: " + sql_strip("s") + "), lambda s: starts_with(s, '|') AND NOT contains(s, '---')), lambda s: list_filter(list_transform(string_split(s, '|'), lambda x: " + sql_strip("x") + "), lambda x: x <> '')), lambda r: len(r) > 0)"
RUN_SQL = "'(\\n\\|[^\\n]+\\|(?:\\n\\|[^\\n]+\\|)*)'"
HEADS = """hh AS (SELECT doc_id, coalesce(doc_title, '') AS title, list_filter(list_transform(regexp_extract_all(text, '(?m)^(#{1,4}[^\\S\\n]+[^\\n]+)$', 1), lambda s: {'level': length(regexp_extract(s, '^(#+)', 1)), 'title': """ + sql_strip("regexp_replace(s, '^#+', '')") + """}), lambda h: h.title <> '') AS hs FROM documents WHERE text IS NOT NULL)"""
IMG = "SELECT filename AS src, 1 AS source_rank, 'image' AS chunk_type, '[Image: ' || filename || ']' || chr(10) || 'Section: ' || coalesce(section, '') || CASE WHEN x <> '' THEN chr(10) || chr(10) || x ELSE chr(10) || 'Context: ' || y END AS content, concat_ws('. ', nullif(section, ''), nullif(breadcrumb, ''), nullif(CASE WHEN x <> '' THEN x ELSE y END, '')) AS embed_text, NULL AS id FROM (SELECT *, " + sql_strip("coalesce(image_content, '')") + " AS x, substr(coalesce(surrounding_before, ''), 1, 200) AS y FROM image_metadata WHERE is_decorative IS DISTINCT FROM true) WHERE (x <> '' OR y <> '') AND filename IS NOT NULL"
LNK = "SELECT url, 2, 'reference_link', 'Reference: ' || coalesce(title, '') || chr(10) || 'URL: ' || url || chr(10) || 'What it contains: ' || coalesce(what_it_contains, '') || chr(10) || 'When to refer: ' || coalesce(when_to_refer, '') || chr(10) || 'Found in: ' || coalesce(found_in_doc, '') || ', section: ' || coalesce(section, ''), concat_ws('. ', nullif(title, ''), nullif(when_to_refer, ''), nullif(what_it_contains, ''), nullif(section, ''), nullif(breadcrumb, '')), substr(md5(url), 1, 12) FROM reference_links WHERE url IS NOT NULL"
RES = "SELECT url, 3, 'restricted_doc', 'Restricted document' || chr(10) || 'URL: ' || url || chr(10) || 'Found in: ' || coalesce(found_in_doc, '') || ', section: ' || coalesce(section, '') || chr(10) || 'Context: ' || substr(coalesce(surrounding_text, ''), 1, 200) || chr(10) || 'Note: ' || coalesce(note, ''), coalesce(nullif(concat_ws('. ', nullif(section, ''), nullif(breadcrumb, ''), nullif(substr(coalesce(surrounding_text, ''), 1, 200), '')), ''), 'Restricted document: ' || url), substr(md5(url), 1, 12) FROM restricted_links WHERE url IS NOT NULL"

ORACLES = {
    "section_split": f"WITH {LINES} SELECT doc_id, sec::INT AS section_no, level::INT AS level, heading, length(content)::INT AS n, md5(content) AS hash FROM b WHERE sec > 0 AND content <> '' AND heading <> ''",
    "meta_carry": f"WITH {LINES} SELECT b.doc_id, b.sec::INT AS section_no, coalesce({_meta('doc')}, b.title) AS doc, coalesce({_meta('section')}, b.heading) AS section, coalesce({_meta('breadcrumb')}, b.title || ' > ' || b.heading) AS breadcrumb, coalesce({_meta('url')}, b.durl) AS url FROM b LEFT JOIN b p ON p.doc_id = b.doc_id AND p.sec = b.sec - 1 WHERE b.sec > 0 AND b.content <> '' AND b.heading <> ''",
    "breadcrumbs": f"WITH RECURSIVE {HEADS}, h AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS n FROM hh), r AS (SELECT doc_id, 0 AS n, [title] AS stack FROM hh UNION ALL SELECT r.doc_id, r.n + 1, list_append(r.stack[1:least(len(r.stack), h.h.level)], h.h.title) FROM r JOIN h ON h.doc_id = r.doc_id AND h.n = r.n + 1) SELECT doc_id, n, array_to_string(stack, ' > ') AS path FROM r WHERE n > 0",
    "section_index": f"WITH {HEADS} SELECT doc_id, '# Section Index: ' || title || chr(10) || chr(10) || array_to_string(list_transform(hs, lambda h: repeat('  ', h.level - 1) || '- ' || h.title), chr(10)) AS content FROM hh WHERE len(hs) > 0",
    "table_linearise": f"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, {RUN_SQL}, 1)) AS tab, generate_subscripts(regexp_extract_all(text, {RUN_SQL}, 1), 1) AS n FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, n, tab, {CELLS.replace('{0}', 'tab')} AS rs FROM x)
        SELECT doc_id, n, md5(CASE WHEN len(rs) = 0 THEN tab ELSE array_to_string(list_concat([array_to_string(rs[1], ' | ')], list_transform(rs[2:], lambda r: array_to_string(list_transform(r, lambda v, i: CASE WHEN i <= len(rs[1]) THEN rs[1][i] || ': ' || v ELSE v END), ', '))), chr(10)) END) AS hash FROM y""",
    "table_split": f"""WITH x AS (SELECT doc_id, string_split_regex(text, '\\n\\|[^\\n]+\\|(?:\\n\\|[^\\n]+\\|)*') AS ts, regexp_extract_all(text, {RUN_SQL}, 1) AS tabs FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(list_concat(ts, tabs)) AS part FROM x), q AS (SELECT doc_id, {sql_strip('part')} AS part FROM p)
        SELECT doc_id, starts_with(part, '|') OR contains(part, '|---') AS is_table, count(*) AS n, sum(length(part))::BIGINT AS chars FROM q WHERE part <> '' GROUP BY ALL""",
    "packed_paragraphs": f"""WITH RECURSIVE a AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\n+'), lambda p: {sql_strip('p')}), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM a),
        r AS (SELECT doc_id, n, p, 1 AS batch, length(p) // 4 AS tok FROM p WHERE n = 1 UNION ALL SELECT p.doc_id, p.n, p.p, CASE WHEN r.tok + length(p.p) // 4 > 512 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.tok + length(p.p) // 4 > 512 THEN length(p.p) // 4 ELSE r.tok + length(p.p) // 4 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.n = r.n + 1)
        SELECT doc_id, batch AS batch_no, (length(string_agg(p, chr(10) || chr(10) ORDER BY n)) // 4)::INT AS n_tokens, md5(string_agg(p, chr(10) || chr(10) ORDER BY n)) AS hash FROM r GROUP BY doc_id, batch""",
    "cross_references": """WITH c AS (SELECT chunk_id, min(content) AS content FROM all_chunks WHERE content IS NOT NULL GROUP BY chunk_id), n AS (SELECT DISTINCT section AS name FROM all_chunks WHERE length(section) > 5 AND regexp_matches(section, '[\\p{L}\\p{N}]')),
        x AS (SELECT chunk_id, name FROM c JOIN n ON contains(lower(content), lower(name)) UNION SELECT chunk_id, unnest(regexp_extract_all(lower(content), '(?:section|refer to|see|as per|refer)\\s+([\\d]+\\.[\\d]+(?:\\.[\\d]+)?)', 1)) FROM c), g AS (SELECT chunk_id, list_sort(list(DISTINCT name)) AS ns FROM x GROUP BY chunk_id)
        SELECT c.chunk_id, array_to_string(coalesce(g.ns, [])[1:10], '; ') AS refs FROM c LEFT JOIN g ON g.chunk_id = c.chunk_id""",
    "union_chunk_sources": f"WITH u AS ({IMG} UNION ALL {LNK} UNION ALL {RES}), v AS (SELECT *, coalesce(id, substr(md5(content), 1, 12)) AS chunk_id FROM u) SELECT chunk_id, chunk_type, source_rank, (length(content) // 4)::INT AS token_count, md5(content) AS content_hash, md5(embed_text) AS embed_hash FROM v QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY source_rank, src, content, embed_text) = 1",
}
