"""Deduplication, upserts, quality, links, conversations and evaluation over the stored tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ids import point_id
from ..operators import conversation as talk
from ..operators import evaluation, html, incremental, quality
from ..operators.chunking import first_wins
from ..operators.links import crawl_levels as levels
from ..operators.links import link_contexts as contexts
from .retrieval import _SPARSE
from .scalar import t


def first_wins_dedup(spark, d):
    rows = t(spark, d, "all_chunks").select("chunk_id", "loaded_at", "doc_title", "section")
    return first_wins(rows, "chunk_id", F.asc_nulls_last("loaded_at"), F.asc_nulls_last("doc_title"), F.asc_nulls_last("section"))


def upsert_last_wins(spark, d):
    rows = t(spark, d, "all_chunks").select(point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", "loaded_at", "doc_title", "section")
    return first_wins(rows, "point_id", F.desc_nulls_last("loaded_at"), F.asc_nulls_last("doc_title"), F.asc_nulls_last("section"), "chunk_id")


def duplicate_count(spark, d):
    n, k = F.count(F.lit(1)), F.count_distinct("chunk_id")
    return t(spark, d, "all_chunks").groupBy("chunk_type").agg(n.alias("n_rows"), k.alias("n_ids"), (n - k).alias("n_removed"))


def type_counts_zero_filled(spark, d):
    return quality.counts_by_type(t(spark, d, "all_chunks"))


def quality_report(spark, d):
    return quality.chunk_report(t(spark, d, "all_chunks"))


def embedding_report(spark, d):
    return quality.embedding_report(t(spark, d, "all_chunks_embedded"), "embedding", 64)


def reuse_or_todo(spark, d):
    new = t(spark, d, "all_chunks").select("chunk_id", "chunk_type").distinct()
    done = t(spark, d, "all_chunks_embedded").select("chunk_id", F.col("embedding").isNotNull().alias("ok")).where("ok")
    return incremental.reuse(new, done, "chunk_id", "ok").select("chunk_id", "chunk_type", "status")


def todo_by_type(spark, d):
    new = t(spark, d, "all_chunks").select("chunk_id", "chunk_type").distinct()
    done, todo = incremental.split_done(new, t(spark, d, "all_chunks_embedded").where("embedding IS NOT NULL"), "chunk_id")
    both = done.withColumn("status", F.lit("done")).unionByName(todo.withColumn("status", F.lit("todo")))
    return both.groupBy("chunk_type", "status").agg(F.count(F.lit(1)).alias("n"))


def link_contexts(spark, d):
    rows = t(spark, d, "reference_links").where("url IS NOT NULL AND source_url IS NOT NULL")
    out = contexts(rows.withColumn("o", F.concat_ws("|", "found_in_doc", "section", "source_url")), "url", "source_url", "o")
    return out.select("url", "source_url", F.array_join("also_found_in", " ").alias("also"), "n")


def crawl_levels(spark, d):
    r = t(spark, d, "doc_registry").where("title IS NOT NULL").select("title", "parent").distinct()
    roots = r.select("title").union(r.select("parent")).where("title IS NOT NULL").distinct().join(r.where("parent IS NOT NULL AND parent <> ''").select("title").distinct(), "title", "left_anti")
    return levels(r.where("parent IS NOT NULL AND parent <> ''"), roots, "parent", "title")


def html_extract(spark, d):
    """Pages made of the registry and read again by the parser: title, link and its text come back."""
    e = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = t(spark, d, "doc_registry").where("url IS NOT NULL").select("url", "title", "parent").groupBy("url").agg(F.min("title").alias("title"), F.min("parent").alias("parent"))
    page = F.concat(F.lit("<html><head><title>"), e(F.col("title")), F.lit("</title><style>x{}</style></head><body><nav><a href='#n'>no</a></nav><h2>"), e(F.col("title")), F.lit("</h2><p>See <a href=\""), F.col("url"), F.lit("\">"), e(F.col("parent")), F.lit("</a> for more<br>now<ul><li>one</ul></body>"))
    out = html.extract(rows.select("url", page.alias("h")), "url", "h")
    return out.select("url", "title", F.get("links", F.lit(0))["href"].alias("href"), F.get("links", F.lit(0))["text"].alias("link_text"), F.md5("markdown").alias("hash"))


def page_contents(spark, d):
    """Tables of contents of pages made of the headings of each document, read again by the parser."""
    hs = t(spark, d, "all_chunks").where("chunk_type = 'section_index' AND content IS NOT NULL").groupBy("chunk_id").agg(F.min("content").alias("content"))
    items = F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^- (.*)$"), 1), lambda x, i: F.concat(F.lit("<li><a href='#h."), i.cast("string"), F.lit("'>"), x, F.lit("</a>")))
    page = F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>"))
    out = html.extract(hs.select("chunk_id", page.alias("h")), "chunk_id", "h")
    return out.select("chunk_id", F.inline(html.contents(F.col("links"))))


def page_links(spark, d):
    """Canonical links of pages made of each document's link records, each once."""
    rows = t(spark, d, "reference_links").where("url IS NOT NULL AND source_url IS NOT NULL").select("source_url", "url").distinct()
    a = F.concat(F.lit("<a href='"), "url", F.lit("/?x=1#f'>x</a> <a href='"), "url", F.lit("'>y</a>"))
    pages = rows.groupBy("source_url").agg(F.array_join(F.array_sort(F.collect_list(a)), " ").alias("h"))
    return html.document_links(html.extract(pages, "source_url", "h"), "source_url").select("source_url", "url")


def collection_stats(spark, d):
    return quality.collection_stats(t(spark, d, "all_chunks"))


def history_window(spark, d):
    rows = talk.turns(t(spark, d, "eval_questions"), "id", "history")
    return talk.last_turns(rows, "id", 2)


def last_user_message(spark, d):
    q = t(spark, d, "eval_questions").withColumn("h", F.concat(F.coalesce("history", F.expr("CAST(array() AS array<struct<role: string, content: string>>)")), F.expr("array(struct('user' AS role, question AS content), struct('assistant' AS role, topic AS content))")))
    return talk.last_user_message(talk.turns(q, "id", "h"), "id")


def prompt_messages(spark, d):
    q = t(spark, d, "eval_questions")
    made = q.select("id", F.posexplode(talk.prompt_messages(F.col("history"), F.lit("Answer from the context."), F.concat(F.lit("Question: "), "question"))).alias("turn", "m"), talk.rewrite_prompt(F.col("history"), F.col("question")).alias("rewrite"))
    return made.select("id", "turn", "m.role", "m.content", "rewrite")


def sse_encode(spark, d):
    rows = t(spark, d, "eval_questions").select("id", F.posexplode(F.split("question", " ")).alias("seq", "w"))
    return rows.select("id", "seq", talk.sse_line(F.lit("token"), F.concat("w", F.lit(" "))).alias("line"))


def sse_fold(spark, d):
    q = t(spark, d, "eval_questions")
    lines = sse_encode(spark, d).unionByName(q.select("id", F.lit(10_000).alias("seq"), talk.sse_line(F.lit("sources"), F.coalesce("expected_source", F.lit("-"))).alias("line"))).unionByName(q.select("id", F.lit(-1).alias("seq"), F.lit(": keep-alive").alias("line")))
    return talk.fold_events(lines, "id")


def _answers(spark, d):
    """The content of the best chunk stands in for an answer, its titles for the cited sources."""
    from .retrieval import _ranked

    best = _ranked(spark, d).where("rank = 1").select("id", F.col("content").alias("answer"), F.concat_ws(" ", "doc_title", "section").alias("sources"))
    return t(spark, d, "eval_questions").join(best, "id", "left")


def eval_checks(spark, d):
    return evaluation.checks(_answers(spark, d)).select("id", "chunk_type", "topic", "answer_pass", "source_pass", "n_found", "n_missing")


def eval_scores(spark, d):
    return evaluation.scores(evaluation.checks(_answers(spark, d))).select("grouping", "chunk_type", "topic", "total", "passed", "sourced")


def event_sessions(spark, d):
    """Extension: sessions of a user end after 30 minutes without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(spark, d, "events").withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")))
    e = e.withColumn("session", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 1_800_000_000), 1).otherwise(0)).over(w))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


def revenue_by_nation(spark, d):
    """Extension: a star join with pushed-down filters."""
    o = t(spark, d, "orders").where("o_totalprice > 1000").select("o_orderkey", "o_custkey")
    j = t(spark, d, "lineitem").select("l_orderkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


QUERIES = {
    f.__name__: f
    for f in (
        first_wins_dedup, upsert_last_wins, duplicate_count, type_counts_zero_filled, quality_report, embedding_report, reuse_or_todo, todo_by_type, link_contexts, crawl_levels, html_extract, page_contents, page_links, collection_stats, history_window, last_user_message,
        prompt_messages, sse_encode, sse_fold, eval_checks, eval_scores, event_sessions, revenue_by_nation,
    )
}

_TYPES = "'text'), ('table'), ('image'), ('reference_link'), ('restricted_doc'), ('section_index'"
_TURNS = "SELECT id, unnest(h).role AS role, unnest(h).content AS content, generate_subscripts(h, 1) - 1 AS turn FROM ({0})"
_BEST = f"{_SPARSE}, cr AS (SELECT * FROM all_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at NULLS LAST, doc_title NULLS LAST, section NULLS LAST, source_url NULLS LAST) = 1), an AS (SELECT sp.id, content AS answer, concat_ws(' ', doc_title, section) AS sources FROM sp JOIN cr USING (chunk_id) WHERE rank = 1)"
_CHECK = f"{_BEST}, ck AS (SELECT e.id, e.chunk_type, e.topic, len(list_filter(expected_keywords, lambda k: contains(lower(coalesce(answer, '')), lower(k)))) AS f, len(expected_keywords) AS n, expected_source IS NULL OR contains(lower(coalesce(sources, '')), lower(expected_source)) AS source_pass FROM eval_questions e LEFT JOIN an USING (id)), cc AS (SELECT *, f >= greatest(1, n // 2) AS answer_pass FROM ck)"
_JSON = "'data: ' || '{\"type\":\"' || {0} || '\",\"text\":' || to_json({1}) || '}' || chr(10) || chr(10)"

ORACLES = {
    "first_wins_dedup": "SELECT chunk_id, loaded_at, doc_title, section FROM all_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at NULLS LAST, doc_title NULLS LAST, section NULLS LAST) = 1",
    "upsert_last_wins": "SELECT ('0x' || substr(md5(chunk_id), 1, 8))::BIGINT AS point_id, chunk_id, loaded_at, doc_title, section FROM all_chunks QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY loaded_at DESC NULLS LAST, doc_title NULLS LAST, section NULLS LAST, chunk_id) = 1",
    "duplicate_count": "SELECT chunk_type, count(*) AS n_rows, count(DISTINCT chunk_id) AS n_ids, count(*) - count(DISTINCT chunk_id) AS n_removed FROM all_chunks GROUP BY chunk_type",
    "type_counts_zero_filled": f"SELECT x.chunk_type, count(a.chunk_id) AS n FROM (VALUES ({_TYPES})) x(chunk_type) LEFT JOIN (SELECT * FROM all_chunks) a ON a.chunk_type = x.chunk_type GROUP BY x.chunk_type",
    "quality_report": "SELECT count(*) AS n_rows, count(DISTINCT chunk_id) AS n_ids, count(*) - count(DISTINCT chunk_id) AS n_duplicates, " + ", ".join(f"count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS no_{c}" for c in ("content", "embed_text", "doc_title", "section", "source_url")) + ", (coalesce(sum(token_count), 0) // greatest(count(*), 1))::BIGINT AS mean_tokens, count(*) FILTER (len(\"references\") > 0) AS n_with_references, count(*) FILTER (len(hyde_questions) > 0) AS n_with_questions, coalesce(sum(len(hyde_questions)), 0)::BIGINT AS n_questions FROM all_chunks",
    "embedding_report": "SELECT count(*) AS n_rows, count(*) FILTER (embedding IS NULL) AS n_missing, count(*) FILTER (len(embedding) <> 64) AS n_wrong_length, count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS n_not_finite, count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x = 0)) = 64) AS n_zero FROM all_chunks_embedded",
    "reuse_or_todo": "SELECT c.chunk_id, c.chunk_type, CASE WHEN e.chunk_id IS NULL THEN 'todo' ELSE 'done' END AS status FROM (SELECT DISTINCT chunk_id, chunk_type FROM all_chunks) c LEFT JOIN (SELECT DISTINCT chunk_id FROM all_chunks_embedded WHERE embedding IS NOT NULL) e ON e.chunk_id = c.chunk_id",
    "todo_by_type": "SELECT chunk_type, CASE WHEN chunk_id IN (SELECT chunk_id FROM all_chunks_embedded WHERE embedding IS NOT NULL) THEN 'done' ELSE 'todo' END AS status, count(*) AS n FROM (SELECT DISTINCT chunk_id, chunk_type FROM all_chunks) GROUP BY ALL",
    "link_contexts": "WITH p AS (SELECT url, source_url, min(concat_ws('|', found_in_doc, section, source_url)) AS o FROM reference_links WHERE url IS NOT NULL AND source_url IS NOT NULL GROUP BY url, source_url), g AS (SELECT url, list(source_url ORDER BY o, source_url) AS l FROM p GROUP BY url) SELECT url, l[1] AS source_url, array_to_string(l[2:], ' ') AS also, len(l)::INT AS n FROM g",
    "crawl_levels": "WITH RECURSIVE r AS (SELECT DISTINCT title, parent FROM doc_registry WHERE title IS NOT NULL), e AS (SELECT * FROM r WHERE parent <> ''), n AS (SELECT title FROM r UNION SELECT parent FROM r WHERE parent IS NOT NULL), w AS (SELECT title AS node, 0 AS level FROM n WHERE title NOT IN (SELECT title FROM e) UNION SELECT e.title, w.level + 1 FROM w JOIN e ON e.parent = w.node WHERE w.level < 200) SELECT node, min(level) AS level FROM w GROUP BY node",
    "html_extract": "SELECT url, min(title) AS title, url AS href, coalesce(min(parent), '') AS link_text, md5('## ' || min(title) || chr(10) || chr(10) || replace('See ' || coalesce(min(parent), '') || ' for more now', '  ', ' ') || chr(10) || chr(10) || '- one') AS hash FROM doc_registry WHERE url IS NOT NULL GROUP BY url",
    "page_contents": "WITH c AS (SELECT chunk_id, min(content) AS content FROM all_chunks WHERE chunk_type = 'section_index' AND content IS NOT NULL GROUP BY chunk_id), x AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all(content, '(?m)^- (.*)$', 1), lambda x, i: {'x': trim(x), 'i': i - 1})) AS e FROM c) SELECT chunk_id, 'h.' || e.i AS anchor, regexp_extract(e.x, '^(\\d+(?:\\.\\d+)*)', 1) AS number, e.x AS title, CASE WHEN regexp_matches(e.x, '^\\d') THEN len(string_split(regexp_extract(e.x, '^(\\d+(?:\\.\\d+)*)', 1), '.')) ELSE 1 END::INT AS level FROM x WHERE e.x <> ''",
    "page_links": "SELECT DISTINCT source_url, u AS url FROM (SELECT source_url, unnest([url || '/?x=1', url]) AS u FROM reference_links WHERE url IS NOT NULL AND source_url IS NOT NULL)",
    "collection_stats": "SELECT count(*) AS points, count(DISTINCT chunk_type) AS types, count(DISTINCT doc_title) AS documents, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM all_chunks",
    "history_window": "SELECT id, turn::INT AS turn, role, content FROM (" + _TURNS.replace("{0}", "SELECT id, history AS h FROM eval_questions") + ") WHERE coalesce(content, '') <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) <= 2",
    "last_user_message": "SELECT id, turn::INT AS turn, role, content, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM (" + _TURNS.replace("{0}", "SELECT id, list_concat(coalesce(history, []), [{'role': 'user', 'content': question}, {'role': 'assistant', 'content': topic}]) AS h FROM eval_questions") + ")",
    "prompt_messages": "WITH x AS (SELECT id, question, coalesce(history, []) AS hs FROM eval_questions), m AS (SELECT id, list_concat(list_concat([{'role': 'system', 'content': 'Answer from the context.'}], list_slice(hs, greatest(len(hs) - 5, 1), len(hs))), [{'role': 'user', 'content': 'Question: ' || question}]) AS h, array_to_string(list_transform(list_slice(hs, greatest(len(hs) - 1, 1), len(hs)), lambda z: z.role || ': ' || z.content), chr(10)) || chr(10) || 'Question: ' || question AS rewrite FROM x) SELECT id, (generate_subscripts(h, 1) - 1)::INT AS turn, unnest(h).role AS role, unnest(h).content AS content, rewrite FROM m",
    "sse_encode": "SELECT id, (generate_subscripts(w, 1) - 1)::INT AS seq, " + _JSON.replace("{0}", "'token'").replace("{1}", "x") + " AS line FROM (SELECT id, w, unnest(w) || ' ' AS x, generate_subscripts(w, 1) AS g FROM (SELECT id, string_split(question, ' ') AS w FROM eval_questions)) WHERE false UNION ALL SELECT id, seq::INT, " + _JSON.replace("{0}", "'token'").replace("{1}", "x") + " FROM (SELECT id, unnest(w) || ' ' AS x, generate_subscripts(w, 1) - 1 AS seq FROM (SELECT id, string_split(question, ' ') AS w FROM eval_questions))",
    "sse_fold": "SELECT id, array_to_string(list_transform(string_split(question, ' '), lambda w: w || ' '), '') AS answer, coalesce(expected_source, '-') AS sources FROM eval_questions",
    "eval_checks": f"WITH {_CHECK} SELECT id, chunk_type, topic, answer_pass, source_pass, f::INT AS n_found, (n - f)::INT AS n_missing FROM cc",
    "eval_scores": f"WITH {_CHECK} SELECT CASE WHEN grouping(chunk_type) = 0 THEN 'chunk_type' WHEN grouping(topic) = 0 THEN 'topic' ELSE 'all' END AS \"grouping\", chunk_type, topic, count(*) AS total, count(*) FILTER (answer_pass) AS passed, count(*) FILTER (source_pass) AS sourced FROM cc GROUP BY GROUPING SETS ((chunk_type), (topic), ())",
    "event_sessions": "WITH g AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL",
    "revenue_by_nation": "SELECT n_name, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 1000 GROUP BY n_name",
}
ORACLES["sse_encode"] = "SELECT id, seq::INT AS seq, " + _JSON.replace("{0}", "'token'").replace("{1}", "x") + " AS line FROM (SELECT id, unnest(w) || ' ' AS x, generate_subscripts(w, 1) - 1 AS seq FROM (SELECT id, string_split(question, ' ') AS w FROM eval_questions))"
