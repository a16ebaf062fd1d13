"""Ids, tokens, terms and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import chunk_id, point_id, word_bucket
from ..functions.rules import classify_image, classify_link, is_off_topic
from ..functions.text import embed_text, front_matter, parse_questions, post_clean, strip_image_blocks, token_count
from ..functions.url import authority, canonical, host, host_label, is_doc, is_external
from ..operators.quality import collisions
from ..operators.sparse import sparse_vectors, term_counts

SQL_STRIP = r"regexp_replace({0}, '^[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+|[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+$', '', 'g')"


def sql_strip(x: str) -> str:
    return SQL_STRIP.format(x)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


WORDS_SQL = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}'))"


def token_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))


def chunk_ids(spark, d):
    return t(spark, d, "documents").select("doc_id", chunk_id(F.col("text")).alias("chunk_id"))


def point_ids(spark, d):
    return t(spark, d, "all_chunks").select("chunk_id").distinct().select("chunk_id", point_id(F.col("chunk_id")).alias("point_id"))


def point_id_collisions(spark, d):
    ids = t(spark, d, "all_chunks").select("chunk_id").distinct().select("chunk_id", (point_id(F.col("chunk_id")) % 10007).alias("slot"))
    return collisions(ids, "slot", "chunk_id")


def term_frequencies(spark, d):
    return term_counts(t(spark, d, "documents"), "doc_id", "text")


def sparse_vector_rows(spark, d):
    return sparse_vectors(t(spark, d, "documents"), "doc_id", "text")


def bucket_collisions(spark, d):
    words = term_counts(t(spark, d, "documents"), "doc_id", "text").select("word").distinct()
    return words.groupBy(word_bucket(F.col("word"), 5000).alias("idx")).agg(F.count(F.lit(1)).alias("n_words")).where("n_words > 1")


def embed_texts(spark, d):
    rows = t(spark, d, "all_chunks").select("chunk_id", F.md5(embed_text(F.col("embed_text"), F.col("hyde_questions"))).alias("hash"))
    return rows.groupBy("chunk_id").agg(F.min("hash").alias("hash"))


def url_canonical(spark, d):
    urls = t(spark, d, "documents").select("source_url").union(t(spark, d, "reference_links").select("url")).distinct()
    dirty = urls.select(F.col("source_url").alias("url"), F.concat("source_url", F.lit("/?x=1#frag")).alias("variant"), F.concat(F.lit("https://www.google.com/url?q="), F.replace("source_url", F.lit("/"), F.lit("%2F")), F.lit("&sa=D")).alias("redirect"))
    return dirty.where("url IS NOT NULL").select("url", canonical(F.col("url")).alias("plain"), canonical(F.col("variant")).alias("cleaned"), canonical(F.col("redirect")).alias("unwrapped"), is_doc(F.col("url")).alias("is_doc"), is_external(F.col("url")).alias("is_external"))


def url_parts(spark, d):
    u = F.col("url")
    return t(spark, d, "reference_links").select("url").where("url IS NOT NULL").distinct().select("url", host(u).alias("host"), authority(u).alias("authority"), host_label(u).alias("label"))


def front_matters(spark, d):
    x = F.col("text")
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *[front_matter(x, k).alias(k) for k in ("doc_title", "source_url", "parent_doc")])


def cleaned_texts(spark, d):
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(post_clean(F.col("text"))).alias("hash"))


def image_block_strip(spark, d):
    return t(spark, d, "documents").where("text LIKE '%[IMAGE:%'").select("doc_id", F.length(strip_image_blocks(F.col("text"))).alias("n"))


def image_classes(spark, d):
    rows = t(spark, d, "image_metadata").select("filename", classify_image(F.col("image_content"), F.col("file_size_kb") * 1024).alias("class"), "image_content", "file_size_kb")
    return rows.select("filename", "class").distinct()


def scan_statistics(spark, d):
    return t(spark, d, "image_metadata").groupBy("scan_method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("image_content").isNull()).alias("n_unread"), F.count_if(F.col("is_decorative")).alias("n_decorative"), F.count_if(F.coalesce("needs_ocr", F.lit(True))).alias("n_to_scan"), F.count_if(F.col("scan_error").isNotNull()).alias("n_errors")
    )


def link_classes(spark, d):
    u, s, c = F.coalesce("url", F.lit("")), F.coalesce("section", F.lit("")), F.coalesce("surrounding_text", F.lit(""))
    return t(spark, d, "reference_links").select("url", "section", classify_link(u, s, c).alias("class")).distinct()


def off_topic_router(spark, d):
    return t(spark, d, "eval_questions").select("id", is_off_topic(F.col("question")).alias("off_topic"))


def question_parse(spark, d):
    rows = t(spark, d, "all_chunks").where("size(hyde_questions) > 0").select("chunk_id", F.array_join("hyde_questions", "\n").alias("response")).distinct()
    return rows.select("chunk_id", F.array_join(parse_questions(F.col("response")), "\n").alias("questions")).distinct()


def skip_log(spark, d):
    """Log lines of links that were not read: the reason is padded, never cut."""
    reason = F.rpad("skip_reason", F.greatest(F.lit(35), F.length("skip_reason")), F.lit(" "))
    return t(spark, d, "restricted_links").where("skip_reason IS NOT NULL AND url IS NOT NULL").select(F.concat(F.lit("SKIP / "), reason, F.lit(" / "), "url").alias("line")).distinct()


QUERIES = {f.__name__: f for f in (token_counts, chunk_ids, point_ids, point_id_collisions, term_frequencies, bucket_collisions, embed_texts, url_canonical, url_parts, front_matters, cleaned_texts, image_block_strip, image_classes, scan_statistics, link_classes, off_topic_router, question_parse, skip_log)} | {"sparse_vectors": sparse_vector_rows}


def _case(rules_sql: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in rules_sql) + f" ELSE '{default}' END"


def _sum_contains(x: str, parts) -> str:
    return " + ".join("(contains({0}, '{1}'))::INT".format(x, p.replace("'", "''")) for p in parts)


def _link_sql() -> str:
    from ..functions.rules import LINK_RULES

    out = []
    for parts, words, category in LINK_RULES:
        a = " OR ".join(f"contains(u, '{p}')" for p in parts) or "true"
        b = " OR ".join(f"contains(c, '{w}')" for w in words) or "true"
        out.append((f"({a}) AND ({b})", category))
    return _case(out, "external_reference")


def _oracles() -> dict[str, str]:
    from ..functions.rules import DIAGRAM_SIGNS, OFF_TOPIC, TABLE_SIGNS

    hexint = "('0x' || substr(md5({0}), 1, {1}))::BIGINT"
    bucket = hexint.format("word", 6) + " % {0}"
    words = WORDS_SQL.format("text")
    fm = "regexp_extract(text, '(?s)\\A---\\n(.*?)\\n---', 1)"
    fm_value = lambda k: f"CASE WHEN regexp_matches(text, '(?s)\\A---\\n(.*?)\\n---') THEN {sql_strip(f'coalesce(list_last(regexp_extract_all({fm}, {chr(39)}(?m)^{k}:([^\\n]*){chr(39)}, 1)), {chr(39)}{chr(39)})')} END AS {k}"
    canon = lambda x: f"rtrim({sql_strip(f'CASE WHEN regexp_matches({x}, {chr(39)}/document/d/{chr(39)}) AND NOT ends_with({x}, {chr(39)}/pub{chr(39)}) THEN split_part({x}, {chr(39)}?{chr(39)}, 1) ELSE {x} END')}, '/')"
    step = lambda x: f"regexp_replace(regexp_replace(split_part({x}, '#', 1), '/u/\\d+/', '/', 'g'), '/(edit|view|copy)(\\?[^\\n]*)?$', '')"
    return {
        "token_counts": "SELECT doc_id, (length(text) // 4)::INT AS n_tokens FROM documents",
        "chunk_ids": "SELECT doc_id, substr(md5(text), 1, 12) AS chunk_id FROM documents",
        "point_ids": f"SELECT DISTINCT chunk_id, {hexint.format('chunk_id', 8)} AS point_id FROM all_chunks",
        "point_id_collisions": f"SELECT slot, count(*) AS n FROM (SELECT DISTINCT chunk_id, {hexint.format('chunk_id', 8)} % 10007 AS slot FROM all_chunks) GROUP BY slot HAVING count(*) > 1",
        "term_frequencies": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({words}) AS word FROM documents) GROUP BY doc_id, word",
        "sparse_vectors": f"""WITH w AS (SELECT doc_id, {words} AS ws FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, len(ws) AS total, unnest(ws) AS word FROM w)
            SELECT doc_id, {bucket.format(100000)} AS idx, count(*) AS n, total FROM x GROUP BY ALL UNION ALL SELECT doc_id, 0, 0, 0 FROM w WHERE len(ws) = 0""",
        "bucket_collisions": f"SELECT {bucket.format(5000)} AS idx, count(*) AS n_words FROM (SELECT DISTINCT unnest({words}) AS word FROM documents) GROUP BY 1 HAVING count(*) > 1",
        "embed_texts": f"""SELECT chunk_id, min(md5(concat_ws(' ', nullif({sql_strip("coalesce(embed_text, '')")}, ''), nullif(array_to_string(coalesce(hyde_questions, []), ' '), '')))) AS hash FROM all_chunks GROUP BY chunk_id""",
        "url_canonical": f"""WITH u AS (SELECT DISTINCT source_url AS url FROM documents UNION SELECT url FROM reference_links), v AS (SELECT url, {step('url')} AS a, {step("url || '/?x=1#frag'")} AS b FROM u WHERE url IS NOT NULL)
            SELECT url, {canon('a')} AS "plain", {canon('b')} AS cleaned, {canon('a')} AS unwrapped, regexp_matches(url, '/document/d/') AS is_doc, starts_with(url, 'http') AND NOT regexp_matches(url, '/document/d/') AND NOT regexp_matches(url, 'facebook.com|twitter.com|instagram.com') AS is_external FROM v""",
        "url_parts": "SELECT DISTINCT url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS authority, upper(substr(split_part(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.', 1), 1, 1)) || lower(substr(split_part(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.', 1), 2)) AS label FROM reference_links WHERE url IS NOT NULL",
        "front_matters": f"SELECT doc_id, {fm_value('doc_title')}, {fm_value('source_url')}, {fm_value('parent_doc')} FROM documents WHERE text IS NOT NULL",
        "cleaned_texts": "SELECT doc_id, md5(" + sql_strip(r"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), '[\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), chr(160), ' '), 'Report abuse|Learn more', '', 'g'), '\[\]\(#[^)]*\)|\[ \]', '', 'g'), '[ \t]+\n', E'\n', 'g')") + ") AS hash FROM documents WHERE text IS NOT NULL",
        "image_block_strip": "SELECT doc_id, length(" + sql_strip(r"regexp_replace(text, '(?s)\[IMAGE:[^\]]+\].*$', '')") + ")::INT AS n FROM documents WHERE contains(text, '[IMAGE:')",
        "image_classes": f"""SELECT DISTINCT filename, CASE WHEN length(trim(x)) < 10 OR file_size_kb * 1024 < 500 THEN 'image_empty' WHEN {_sum_contains('lower(x)', TABLE_SIGNS)} >= 2 OR length(x) - length(replace(x, '|', '')) >= 3 THEN 'image_table'
            WHEN {_sum_contains('lower(x)', DIAGRAM_SIGNS)} >= 2 THEN 'image_diagram' ELSE 'image_text' END AS class FROM (SELECT filename, coalesce(image_content, '') AS x, file_size_kb FROM image_metadata)""",
        "scan_statistics": "SELECT scan_method, count(*) AS n, count(*) FILTER (image_content IS NULL) AS n_unread, count(*) FILTER (is_decorative) AS n_decorative, count(*) FILTER (coalesce(needs_ocr, true)) AS n_to_scan, count(*) FILTER (scan_error IS NOT NULL) AS n_errors FROM image_metadata GROUP BY scan_method",
        "link_classes": f"SELECT DISTINCT url, section, {_link_sql()} AS class FROM (SELECT url, section, lower(coalesce(url, '')) AS u, lower(coalesce(section, '')) || ' ' || lower(coalesce(surrounding_text, '')) AS c FROM reference_links)",
        "off_topic_router": "SELECT id, " + " OR ".join(f"contains(trim(lower(question)), '{p}')" for p in OFF_TOPIC) + " AS off_topic FROM eval_questions",
        "question_parse": f"""SELECT DISTINCT chunk_id, array_to_string(list_filter(list_transform(string_split(array_to_string(hyde_questions, chr(10)), chr(10)), lambda s: {sql_strip(f"ltrim({sql_strip('s')}, '0123456789.-)*• ')")}), lambda s: length(s) > 10 AND contains(s, '?'))[1:3], chr(10)) AS questions FROM all_chunks WHERE len(hyde_questions) > 0""",
        "skip_log": "SELECT DISTINCT 'SKIP / ' || rpad(skip_reason, greatest(35, length(skip_reason))::INT, ' ') || ' / ' || url AS line FROM restricted_links WHERE skip_reason IS NOT NULL AND url IS NOT NULL",
    }


ORACLES = _oracles()
