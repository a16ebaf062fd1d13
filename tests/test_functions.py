"""Golden cases of the scalar layer."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marlstone.functions import ids, rules, text, url
from marlstone.operators import evaluation, tables
from marlstone.operators.chunking import numeric_references, pack_paragraphs
from marlstone.operators.sections import breadcrumbs
from marlstone.operators.sparse import sparse_vectors


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'string'}" for k in values) or "x int")
    return row.select(col.alias("v")).first()["v"]


def test_sparse_vectors_and_empty_text(spark):
    df = spark.createDataFrame([(1, "The fee fee is 1500, café fee2 a_b x OK"), (2, "123 é"), (3, None)], "id int, t string")
    got = {(r["id"], r["idx"]): (r["n"], r["total"]) for r in sparse_vectors(df, "id", "t").collect()}
    assert got == {(1, 21868): (1, 5), (1, 6335): (2, 5), (1, 59153): (1, 5), (1, 75851): (1, 5), (2, 0): (0, 0)}


def test_ids(spark):
    assert one(spark, ids.chunk_id(F.col("t")), t="# Fees\n\nhello") == "eb9de10c258b"
    assert one(spark, ids.point_id(F.col("t")), t="eb9de10c258b") == 431826927
    assert one(spark, ids.point_id(F.col("t")), t="5c31bd96c1d0") == 2603517707
    h = hashlib.md5(b"zebra").hexdigest()
    assert one(spark, ids.word_bucket(F.col("t")), t="zebra") == int(h[:6], 16) % 100_000


@pytest.mark.parametrize(
    "href, out",
    [
        ("https://www.google.com/url?q=https%3A%2F%2Fexample.org%2Fa%2Bb&sa=D", "https://example.org/a+b"),
        ("https://docs.google.com/document/u/0/d/ABC/edit?usp=sharing", "https://docs.google.com/document/d/ABC"),
        ("https://docs.google.com/document/d/e/X/pub?embedded=true", "https://docs.google.com/document/d/e/X/pub"),
        ("https://docs.google.com/document/d/e/X/pub#h.1", "https://docs.google.com/document/d/e/X/pub"),
        ("https://example.org/p//?x=1", "https://example.org/p//?x=1"),
        ("https://example.org/view", "https://example.org"),
        (None, ""),
    ],
)
def test_canonical_url(spark, href, out):
    assert one(spark, url.canonical(F.col("t")), t=href) == out


def test_canonical_is_idempotent(spark):
    u = "https://a.example/u/1/document/d/Q/edit#x"
    once = one(spark, url.canonical(F.col("t")), t=u)
    assert one(spark, url.canonical(F.col("t")), t=once) == once


def test_linearise(spark):
    t = "| Level | Credits | Total |\n|---|---|---|\n| Foundation | 32 | 48000 |"
    assert one(spark, tables.linearise(F.col("t")), t=t) == "Level | Credits | Total\nLevel: Foundation, Credits: 32, Total: 48000"
    q = "| a | b | c |\n|---|---|---|\n| 1 |  | 3 |\n| 4 | x\\|y | 6 |\n| p---q | 1 | 2 |"
    assert one(spark, tables.linearise(F.col("t")), t=q) == "a | b | c\na: 1, b: 3\na: 4, b: x\\, c: y, 6"


def test_breadcrumbs(spark):
    hs = F.expr("from_json('[{\"level\":1,\"title\":\"A\"},{\"level\":3,\"title\":\"B\"},{\"level\":2,\"title\":\"C\"},{\"level\":4,\"title\":\"E\"},{\"level\":1,\"title\":\"F\"}]', 'array<struct<level: int, title: string>>')")
    assert one(spark, breadcrumbs(hs, F.lit("D"))) == ["D > A", "D > A > B", "D > A > C", "D > A > C > E", "D > F"]


def test_image_block_strip(spark):
    t = "Intro text\n[IMAGE:img_001.png]\nctx\nmore text\n[IMAGE: duplicate — x]\ntail"
    assert one(spark, text.strip_image_blocks(F.col("t")), t=t) == "Intro text"


def test_numeric_references(spark):
    assert one(spark, numeric_references(F.col("t")), t="see section 5.1 and refer to 3.2.1, see 7") == ["5.1", "3.2.1"]


def test_parse_questions(spark):
    t = "Here are questions:\n1. What is the fee?\n2) Why?\n• How do I register now?\n- 2024 fee waiver rules?\n* Is the viva mandatory now?"
    assert one(spark, text.parse_questions(F.col("t")), t=t) == ["What is the fee?", "How do I register now?", "fee waiver rules?"]


@pytest.mark.parametrize("answer, words, ok", [("Fee is 48,000", ["48000", "48,000", "foundation"], True), ("a b", list("abcde"), True), ("a", list("abcde"), False), ("x", [], False)])
def test_answer_check(spark, answer, words, ok):
    df = spark.createDataFrame([(answer, words)], "a string, w array<string>")
    assert df.select(evaluation.answer_passes(F.col("a"), F.col("w")).alias("v")).first()["v"] is ok


@pytest.mark.parametrize("q, off", [("Delhi fee?", True), ("hi", False), ("hi there", True), ("What is the fee?", False), ("game theory course", True)])
def test_router(spark, q, off):
    assert one(spark, rules.is_off_topic(F.col("t")), t=q) is off


def test_token_floor(spark):
    assert [one(spark, text.token_count(F.col("t")), t="a" * n) for n in (199, 200)] == [49, 50]


def test_packing(spark):
    paragraphs = ["a" * 1200, "b" * 848, "c" * 4, "d" * 2400, "e" * 20]
    got = one(spark, pack_paragraphs(F.col("t"), 512), t="\n\n".join(paragraphs))
    assert got == ["\n\n".join(paragraphs[:2]), paragraphs[2], paragraphs[3], paragraphs[4]]


@pytest.mark.parametrize("t, n, kind", [("", 5000, "image_empty"), ("123456789", 5000, "image_empty"), ("hello wide world", 400, "image_empty"), ("fee per term", 5000, "image_table"), ("step by step process", 5000, "image_diagram"), ("hello world text", 5000, "image_text")])
def test_image_class(spark, t, n, kind):
    assert one(spark, rules.classify_image(F.col("t"), F.lit(n)), t=t) == kind


def test_emitters_and_titles(spark):
    assert one(spark, text.clean_title(F.col("t")), t="Copy of Guide - Google Docs (x)") == "Guide"
    assert one(spark, text.heading_line(F.lit(2), F.col("t"), F.lit("3.1")), t="Fees") == "## 3.1 Fees" and one(spark, text.heading_line(F.lit(1), F.col("t"), F.lit("3.1")), t="3.1 Fees") == "# 3.1 Fees"
    line = one(spark, text.meta_comment(F.lit("D"), F.lit("S"), F.lit("D > S"), F.col("t")), t="https://x.example/a:b")
    back = [one(spark, text.parse_meta(F.col("t"), k), t=line) for k in ("doc", "section", "breadcrumb", "url", "none")]
    assert back == ["D", "S", "D > S", "https://x.example/a:b", None]
    block = one(spark, text.front_matter_block(F.lit("T"), F.lit("U"), F.lit(""), F.col("t")), t="now")
    assert [one(spark, text.front_matter(F.col("t"), k), t=block) for k in ("doc_title", "source_url", "parent_doc")] == ["T", "U", ""]
    assert one(spark, text.question_prompt(F.col("t"), F.lit("S")), t="short") is None and one(spark, text.question_prompt(F.col("t"), F.lit("S")), t="z" * 2000).count("z") == 1500
    assert one(spark, text.strip_citation(F.col("t")), t="answer\n\n📎 source") == "answer"


def test_scan_result(spark):
    r = lambda t, e, n, w: one(spark, rules.scan_result(F.col("t"), F.lit(e).cast("string"), F.lit(n), F.lit(w), F.lit(50)), t=t)
    assert tuple(r("fee per term", None, 400, 50)) == ("image_empty", True, "size")
    assert tuple(r(None, "failed", 900, 5)) == ("image_empty", True, "dimensions") and tuple(r(None, "failed", 900, 50)) == ("image_text", False, "fallback")
    assert tuple(r("fee per term", None, 900, 50)) == ("image_table", False, "ocr") and tuple(r("", None, 900, 50)) == ("image_empty", True, "ocr")
