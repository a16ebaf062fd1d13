"""Queries of this subpackage's operators over the data set, with production parameters on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import table
from .encoding import VOCABULARY, count_tokens, encode_texts
from .knn import nearest
from .neardup import expand_pairs, group_ids, near_duplicates
from .packing import container_fill, pack
from .pairs import find_defects
from .residue import find_residue
from .scan_repair import find_noise, repair
from .spam import find_spam
from .splitting import split_oversized


def _residue(spark: SparkSession, d: str) -> DataFrame:
    images = find_residue(table(spark, d, "image_metadata"), "filename", "image_content").withColumnRenamed("filename", "record_key")
    chunks = find_residue(table(spark, d, "all_chunks"), "chunk_id", "content").withColumnRenamed("chunk_id", "record_key")
    return images.withColumn("record_table", F.lit("image_metadata")).unionByName(chunks.withColumn("record_table", F.lit("all_chunks")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).select("record_table", "record_key")


def p1_residue(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and kinds of every record with residue."""
    return _residue(spark, d)


def _limits(spark: SparkSession, d: str) -> dict[str, tuple[int, int]]:
    """The three rows of size_limits."""
    return {r["limit_name"]: (r["max_tokens"], r["overlap_tokens"]) for r in table(spark, d, "size_limits").limit(100).collect()}


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every usable vector."""
    return nearest(table(spark, d, "all_chunks_embedded"), "chunk_id", "embedding", 5, 64)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = p2_neighbours(spark, d)
    a, b = F.col("chunk_id"), F.col("neighbour")
    return near.select(F.least(a, b).alias("chunk_id_a"), F.greatest(a, b).alias("chunk_id_b")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return find_noise(table(spark, d, "image_metadata"), "filename", "image_content")


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every scanned record."""
    return repair(table(spark, d, "image_metadata"), "filename", "image_content")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, d, "all_chunks").where(F.col("chunk_type").isin("text", "table"))
    return near_duplicates(chunks, "chunk_id", "content", 0.7)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs, as the data set defines them; those of equal sets are expanded here and only here."""
    return expand_pairs(*_near(spark, d)).toDF("chunk_id_a", "chunk_id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk: its group and its number of links."""
    return group_ids(*_near(spark, d)).toDF("chunk_id", "group_id", "n_links")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = _limits(spark, d)["chunk_split"]
    return split_oversized(table(spark, d, "all_chunks"), "chunk_id", "content", size, overlap, ("breadcrumb",))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The oversized chunks and the weakest boundary each needs, from the pieces of the same operator."""
    size, overlap = _limits(spark, d)["chunk_split"]
    pieces = split_oversized(table(spark, d, "all_chunks"), "chunk_id", "content", size, overlap)
    return pieces.where("piece_no = 0").select("chunk_id", "boundary")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "all_chunks").where(F.col("chunk_type").isin("text", "table"))
    return find_defects(chunks, "chunk_id", "hyde_questions", "content", "chunk_type")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), vocabulary=VOCABULARY)


def _packed(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    sized = cut_lineage(count_tokens(table(spark, d, "documents"), vocabulary=VOCABULARY))
    limits = _limits(spark, d)
    return [(name, limits[name][0], pack(sized, "doc_id", "n_tokens", limits[name][0])) for name in ("pack_small", "pack_large")]


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document in its container, for both capacities."""
    parts = [p.select(F.lit(n).alias("limit_name"), "*") for n, _, p in _packed(spark, d)]
    return reduce(DataFrame.unionByName, parts)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of both capacities are."""
    parts = [container_fill(p, c).select(F.lit(n).alias("limit_name"), "*") for n, c, p in _packed(spark, d)]
    return reduce(DataFrame.unionByName, parts)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: documents placed, containers above the capacity, pieces placed twice, documents split without need, groups out of balance."""
    parts = []
    for n, c, p in _packed(spark, d):
        p = cut_lineage(p)
        full = p.groupBy("container").agg(F.sum("size").alias("load"), F.count_distinct("step_group").alias("groups"))
        pieces = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("places"), F.sum("size").alias("n"))
        sizes = p.groupBy("step_group").agg(F.count_distinct("container").alias("held"))
        a = full.agg(F.count_if(F.col("load") > c).alias("overfull"), F.count_if(F.col("groups") > 1).alias("torn"))
        b = pieces.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("pieces") != F.col("places")).alias("twice"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= c)).alias("split"))
        g = sizes.agg((F.coalesce(F.max("held") - F.min("held"), F.lit(0)) > 1).alias("uneven"))
        a, b, g = (x.withColumn("limit_name", F.lit(n)) for x in (a, b, g))
        parts.append(a.join(b, "limit_name").join(g, "limit_name").select("limit_name", "documents", "overfull", "torn", "twice", "split", "uneven"))
    return reduce(DataFrame.unionByName, parts)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_spam(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_text": p3_text, "p4_found": p4_found, "p4_groups": p4_groups, "p1_found": p1_found, "p1_residue": p1_residue, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_checks": p8_checks, "p9_found": p9_found}

#: White space as the operators see it, for a dialect whose \s is ASCII only.
_S = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _parts(x: str, pattern: str) -> str:
    """All parts of a list of texts, cut at a pattern and trimmed."""
    trim = f"regexp_replace(p, '^{_S}+|{_S}+$', '', 'g')"
    return f"list_transform(flatten(list_transform({x}, lambda t: string_split_regex(t, '{pattern}'))), lambda p: {trim})"


_FITS = "len(list_filter({0}, lambda p: length(p) // 4 > lim)) = 0"
_P5 = f"""WITH c AS (SELECT chunk_id, max_tokens AS lim, min(content) AS content FROM all_chunks JOIN size_limits ON limit_name = 'chunk_split' AND length(content) // 4 > max_tokens GROUP BY ALL),
    a AS (SELECT chunk_id, lim, {_parts('[content]', chr(92) + 'n' + _S + '*' + chr(92) + 'n')} AS k1 FROM c), b AS (SELECT *, {_parts('k1', chr(92) + 'n')} AS k2 FROM a),
    d AS (SELECT *, list_transform(k2, lambda t: regexp_replace(t, '([.!?]){_S}+', chr(92) || '1' || chr(1), 'g')) AS marked FROM b), e AS (SELECT *, {_parts('marked', chr(92) + 'x01')} AS k3 FROM d), f AS (SELECT *, {_parts('k3', _S + '+')} AS k4 FROM e)
    SELECT chunk_id, CASE WHEN {_FITS.format('k1')} THEN 'paragraph' WHEN {_FITS.format('k2')} THEN 'line' WHEN {_FITS.format('k3')} THEN 'sentence' WHEN {_FITS.format('k4')} THEN 'word' ELSE 'none' END AS boundary FROM f""".replace("chr(92) || '1'", "'" + chr(92) + "1'")
_P4 = r"""WITH c AS (SELECT chunk_id, regexp_extract_all(lower(min(content)), '[\p{L}\p{N}]+') AS w FROM all_chunks WHERE chunk_type IN ('text', 'table') AND content IS NOT NULL GROUP BY chunk_id), s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM c WHERE len(w) >= 50),
    n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id), p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
    SELECT x AS chunk_id_a, y AS chunk_id_b FROM p JOIN n u ON u.chunk_id = x JOIN n v ON v.chunk_id = y WHERE m >= 0.7 * (u.n + v.n - m)"""

_P4_PAIRS = _P4[: _P4.index("    SELECT x AS")] + """, q AS (SELECT x, y, m = u.n AND m = v.n AS same FROM p JOIN n u ON u.chunk_id = x JOIN n v ON v.chunk_id = y WHERE m >= 0.7 * (u.n + v.n - m)), e AS (SELECT x, y, same FROM q UNION ALL SELECT y, x, same FROM q)"""
_P4_GROUPS = _P4_PAIRS.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, k AS (SELECT n.chunk_id, least(n.chunk_id, min(e.y) FILTER (e.same)) AS rep, count(*) FILTER (e.same) AS copies FROM n LEFT JOIN e ON e.x = n.chunk_id GROUP BY n.chunk_id),
    r AS (SELECT chunk_id, chunk_id AS reached FROM n UNION SELECT r.chunk_id, e.y FROM r JOIN e ON e.x = r.reached), g AS (SELECT chunk_id, min(reached) AS group_id FROM r GROUP BY chunk_id), o AS (SELECT e.x, count(DISTINCT k.rep) AS others FROM e JOIN k ON k.chunk_id = e.y WHERE NOT e.same GROUP BY e.x)
    SELECT g.chunk_id, g.group_id, coalesce(o.others, 0) + k.copies AS n_links FROM g JOIN k ON k.chunk_id = g.chunk_id LEFT JOIN o ON o.x = g.chunk_id"""
_P8_CHECKS = "SELECT limit_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, 0 AS overfull, 0 AS torn, 0 AS twice, 0 AS split, false AS uneven FROM size_limits WHERE limit_name IN ('pack_small', 'pack_large')"

ORACLES: dict[str, str] = {"p4_found": _P4, "p4_groups": _P4_GROUPS, "p5_found": _P5, "p8_checks": _P8_CHECKS}
