"""Dense, sparse and hybrid retrieval, its fallback, context and sources."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..lineage import cut_lineage
from ..operators.chunking import first_wins
from ..operators.context import context_text as context_texts
from ..operators.context import sources
from ..operators.conversation import rewrite_prompt
from ..operators.dense import dense_topk as dense
from ..operators.hybrid import expand_references, fuse, with_fallback
from ..operators.sparse import packed_vectors
from ..operators.sparse import sparse_topk as sparse
from .scalar import WORDS_SQL, t

#: A term product is far below a cosine, so the gate for citing is lower here.
CITE = replace(DEFAULTS, source_gate=0.01)


def _queries_by_vector(spark, d):
    """Every vector whose id is divisible by 50 asks."""
    return t(spark, d, "embeddings").where("vec_id % 50 = 0")


def dense_topk(spark, d):
    e = t(spark, d, "embeddings")
    q = _queries_by_vector(spark, d).withColumnRenamed("vec_id", "qid")
    return dense(q, e.withColumnRenamed("vec_id", "pid"), "qid", "pid", "embedding", 20, skip_self=True)


def _questions(spark, d):
    return packed_vectors(t(spark, d, "eval_questions"), "id", "question")


def _chunk_texts(spark, d):
    return t(spark, d, "all_chunks").where("embed_text IS NOT NULL").groupBy("chunk_id").agg(F.min("embed_text").alias("text"))


def _sparse(spark, d, k=20):
    return sparse(_questions(spark, d), packed_vectors(_chunk_texts(spark, d), "chunk_id", "text"), "id", "chunk_id", k)


def sparse_topk(spark, d):
    return _sparse(spark, d)


def _hybrid(spark, d, k):
    docs = t(spark, d, "documents").select("doc_id", "text")
    vectors = t(spark, d, "embeddings").withColumnRenamed("vec_id", "pid")
    asking = docs.join(_queries_by_vector(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    qs = packed_vectors(asking.select(F.col("doc_id").alias("qid"), "text"), "qid", "text")
    s = sparse(qs, packed_vectors(docs.withColumnRenamed("doc_id", "pid"), "pid", "text"), "qid", "pid", k, skip_self=True)
    v = dense(asking.select(F.col("doc_id").alias("qid"), "embedding"), vectors, "qid", "pid", "embedding", k, skip_self=True)
    return fuse(v, s, "qid", "pid")


def hybrid_topk(spark, d):
    return _hybrid(spark, d, 20).where("rank <= 20")


def confidence_fallback(spark, d):
    """The first pass asks with the question made to stand alone by the last turns; where that is weak, the plain question with more candidates may replace it.

    Questions have no vectors here, so both passes rest on the sparse side.
    """
    q = t(spark, d, "eval_questions").select("id", "question", F.when(F.size("history") > 0, rewrite_prompt(F.col("history"), F.col("question"))).otherwise(F.col("question")).alias("standalone"))
    points = cut_lineage(packed_vectors(_chunk_texts(spark, d), "chunk_id", "text"))
    none = spark.createDataFrame([], "id string, chunk_id string, score bigint, rank int")
    ask = lambda text, k: fuse(none, sparse(packed_vectors(q, "id", text), points, "id", "chunk_id", k), "id", "chunk_id")
    first, broad = cut_lineage(ask("standalone", 20)), cut_lineage(ask("question", 30))
    return with_fallback(first, broad, "id").where("rank <= 4").select("id", "chunk_id", "fused", "raw", "rank", "branch")


def _chunk_rows(spark, d):
    """One row per chunk with what context and expansion need."""
    cols = ["chunk_id", "chunk_type", "content", "doc_title", "section", "source_url", "link_url", "link_text", "what_it_contains", "when_to_refer", "note", "image_file", "image_content", "references"]
    return first_wins(t(spark, d, "all_chunks").select(*cols, "loaded_at"), "chunk_id", F.asc_nulls_last("loaded_at"), F.asc_nulls_last("doc_title"), F.asc_nulls_last("section"), F.asc_nulls_last("source_url"))


def crossref_expand(spark, d):
    top = _sparse(spark, d, 4)
    chunks = _chunk_rows(spark, d).select("chunk_id", F.substring_index("section", " ", -2).alias("section"), "references")
    return expand_references(top, chunks, "id", "chunk_id")


def _ranked(spark, d):
    top = _sparse(spark, d, 4).withColumnRenamed("score", "raw")
    return top.join(_chunk_rows(spark, d), "chunk_id")


def context_sources(spark, d):
    return sources(_ranked(spark, d), "id", CITE)


def context_text(spark, d):
    return context_texts(_ranked(spark, d), "id").select("id", F.md5("context").alias("hash"), F.length("context").alias("n"))


QUERIES = {f.__name__: f for f in (dense_topk, sparse_topk, hybrid_topk, confidence_fallback, crossref_expand, context_sources, context_text)}

_BUCKET = "('0x' || substr(md5(w), 1, 6))::BIGINT % 100000"


def _terms(name: str, rel: str, key: str, text: str) -> str:
    return f"{name}0 AS (SELECT {key} AS k, {WORDS_SQL.format(text)} AS ws FROM {rel}), {name} AS (SELECT k, idx, count(*) AS n, any_value(total) AS total FROM (SELECT k, {_BUCKET} AS idx, total FROM (SELECT k, len(ws) AS total, unnest(ws) AS w FROM {name}0)) GROUP BY k, idx)"


def _score(q: str, p: str, extra: str = "") -> str:
    return f"SELECT q.k AS qid, p.k AS pid, floor(sum(q.n * p.n)::DOUBLE / (any_value(q.total) * any_value(p.total)) * 1e6 + 0.5)::BIGINT AS score FROM {q} q JOIN {p} p USING (idx) {extra} GROUP BY q.k, p.k"


_SPARSE = _terms("qt", "eval_questions", "id", "question") + ", ct AS (SELECT chunk_id, min(embed_text) AS text FROM all_chunks WHERE embed_text IS NOT NULL GROUP BY chunk_id), " + _terms("pt", "ct", "chunk_id", "text") + f", sc AS ({_score('qt', 'pt')}), sp AS (SELECT qid AS id, pid AS chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM sc)"
_ROWS = 'cr AS (SELECT * FROM all_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at NULLS LAST, doc_title NULLS LAST, section NULLS LAST, source_url NULLS LAST) = 1)'
_DENSE = "SELECT q.vec_id AS qid, p.vec_id AS pid, floor(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) * 1e6 + 0.5)::BIGINT AS score FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0"


def _hybrid_sql(n: str, k: int, text: str) -> str:
    return (
        f"{n}q AS (SELECT doc_id, {text} AS t FROM documents JOIN embeddings ON vec_id = doc_id WHERE vec_id % 50 = 0), " + _terms(f"{n}qt", f"{n}q", "doc_id", "t") + ", " + _terms(f"{n}pt", "documents", "doc_id", "text")
        + f", {n}s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS r FROM ({_score(f'{n}qt', f'{n}pt', 'WHERE q.k <> p.k')}) QUALIFY r <= {k})"
        + f", {n}d AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS r FROM ({_DENSE} AND q.vec_id IN (SELECT doc_id FROM documents)) QUALIFY r <= {k})"
        + f", {n}f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.pid, b.pid) AS pid, coalesce(a.score, 0) * 7 + coalesce(b.score, 0) * 3 AS fused, coalesce(a.score, b.score) AS raw, a.r AS dense_rank, b.r AS sparse_rank FROM {n}d a FULL JOIN {n}s b ON a.qid = b.qid AND a.pid = b.pid)"
        + f", {n}h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank FROM {n}f)"
    )


ORACLES = {
    "dense_topk": f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM ({_DENSE}) QUALIFY rank <= 20",
    "sparse_topk": f"WITH {_SPARSE} SELECT * FROM sp WHERE rank <= 20",
    "hybrid_topk": f"WITH {_hybrid_sql('xa', 20, 'text')} SELECT qid, pid, fused, raw, dense_rank, sparse_rank, rank FROM xah WHERE rank <= 20",
    "confidence_fallback": "WITH eq AS (SELECT id, question, CASE WHEN len(history) > 0 THEN array_to_string(list_transform(history[-2:], lambda m: m.role || ': ' || m.content), chr(10)) || chr(10) || 'Question: ' || question ELSE question END AS standalone FROM eval_questions), ct AS (SELECT chunk_id, min(embed_text) AS text FROM all_chunks WHERE embed_text IS NOT NULL GROUP BY chunk_id), "
    + ", ".join([_terms("pt", "ct", "chunk_id", "text"), _terms("qa", "eq", "id", "standalone"), _terms("qb", "eq", "id", "question")])
    + f", fa AS (SELECT qid AS id, pid AS chunk_id, score * 3 AS fused, score AS raw, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM ({_score('qa', 'pt')}) QUALIFY rank <= 20), fb AS (SELECT qid AS id, pid AS chunk_id, score * 3 AS fused, score AS raw, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM ({_score('qb', 'pt')}) QUALIFY rank <= 30)"
    + """, m AS (SELECT x.id, x.t1 < 3000000 AND coalesce(y.t2, -1) > x.t1 AS broad FROM (SELECT id, max(fused) AS t1 FROM fa GROUP BY id) x LEFT JOIN (SELECT id, max(fused) AS t2 FROM fb GROUP BY id) y ON x.id = y.id)
        SELECT id, chunk_id, fused, raw, rank, 'first' AS branch FROM fa JOIN m USING (id) WHERE NOT broad AND rank <= 4 UNION ALL SELECT id, chunk_id, fused, raw, rank, 'broad' FROM fb JOIN m USING (id) WHERE broad AND rank <= 4""",
    "crossref_expand": f"""WITH {_SPARSE}, {_ROWS}, x AS (SELECT chunk_id, array_to_string(list_reverse(list_reverse(string_split(section, ' '))[1:2]), ' ') AS section, "references" FROM cr), r AS (SELECT DISTINCT sp.id, unnest(x."references"[1:3]) AS section FROM sp JOIN x USING (chunk_id) WHERE rank <= 4),
        n AS (SELECT DISTINCT r.id, x.chunk_id FROM r JOIN x ON x.section = r.section) SELECT id, chunk_id FROM n WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.id = n.id AND sp.chunk_id = n.chunk_id AND sp.rank <= 4) QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_id) <= 5""",
    "context_sources": f"""WITH {_SPARSE}, {_ROWS}, k AS (SELECT sp.id, sp.rank, sp.score, cr.*, CASE WHEN chunk_type IN ('text', 'table', 'section_index') THEN 'document' WHEN chunk_type = 'image' THEN 'image' WHEN chunk_type = 'reference_link' THEN 'link' ELSE 'restricted' END AS kind FROM sp JOIN cr ON cr.chunk_id = sp.chunk_id WHERE rank <= 4),
        g AS (SELECT *, kind IN ('document', 'image') AS claims FROM k WHERE kind <> 'document' OR (score > 10000 AND NOT coalesce(regexp_matches(lower(section), 'this will be in effect|important advisory|section index'), false)))
        SELECT id, rank, doc_title AS doc, section, CASE WHEN claims THEN source_url ELSE coalesce(link_url, source_url) END AS url, kind FROM g QUALIFY NOT claims OR row_number() OVER (PARTITION BY id, doc_title, section, claims ORDER BY rank) = 1""",
    "context_text": f"""WITH {_SPARSE}, {_ROWS}, k AS (SELECT sp.id, sp.rank, cr.*, coalesce(section, '') AS sec, coalesce(source_url, '') AS su, coalesce(link_url, source_url, '') AS lu FROM sp JOIN cr ON cr.chunk_id = sp.chunk_id WHERE rank <= 4), b AS (SELECT id, rank, CASE chunk_type
        WHEN 'image' THEN '[IMAGE: ' || sec || ' | URL: ' || su || ']' || chr(10) || 'Image file: ' || coalesce(image_file, '') || chr(10) || 'Content: ' || coalesce(nullif(image_content, ''), content)
        WHEN 'reference_link' THEN '[REFERENCE LINK: ' || sec || ' | URL: ' || lu || ']' || chr(10) || 'Title: ' || coalesce(link_text, '') || chr(10) || 'URL: ' || lu || chr(10) || 'Contains: ' || coalesce(what_it_contains, '') || chr(10) || 'Use when: ' || coalesce(when_to_refer, '')
        WHEN 'restricted_doc' THEN '[RESTRICTED DOCUMENT: ' || sec || ' | URL: ' || lu || ']' || chr(10) || 'URL: ' || lu || chr(10) || 'Note: ' || coalesce(note, '') || chr(10) || 'Context: ' || coalesce(content, '')
        ELSE '[SOURCE: ' || coalesce(doc_title, '') || ' — ' || sec || ' | URL: ' || su || ']' || chr(10) || coalesce(content, '') END AS x FROM k)
        SELECT id, md5(string_agg(x, chr(10) || chr(10) ORDER BY rank)) AS hash, length(string_agg(x, chr(10) || chr(10) ORDER BY rank))::INT AS n FROM b GROUP BY id""",
}
