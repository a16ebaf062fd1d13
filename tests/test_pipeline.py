"""Operators against plain restatements, and the front of the engine."""

import hashlib
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.config import DEFAULTS, Settings
from marlstone.engine import Engine
from marlstone.lineage import cut_lineage
from marlstone.models import complete, hashed_embedder
from marlstone.operators import conversation, html, incremental, quality
from marlstone.operators.chunking import document_chunks, first_wins, image_chunks, link_chunks, restricted_chunks, union_chunks
from marlstone.operators.hybrid import expand_references, fuse, with_fallback
from marlstone.operators.links import crawl_levels
from marlstone.operators.numbering import number_rows
from marlstone.operators.sections import split_sections, with_metadata
from marlstone.sources import files, web
from marlstone.streaming import ingest


def plain_sections(md):
    """Sections by a line scan."""
    out, pending, cur = [], None, None
    for line in md.split("\n"):
        if line.strip().startswith("<!-- meta"):
            pending = line
        elif re.match(r"^#{1,4}\s+.+$", line):
            cur = {"heading": line.lstrip("#").strip(), "lines": [line], "meta": pending}
            pending = None
            out.append(cur)
        elif cur:
            cur["lines"].append(line)
    return [(s["heading"], "\n".join(s["lines"]).strip(), s["meta"]) for s in out]


DOC = """---
doc_title: Guide
source_url: https://x.example/g
parent_doc:
---

lost text
<!-- meta | doc:G1 | section:S1 | breadcrumb:G1 > S1 | url:https://x.example/1 -->
# Alpha

{a}
<!-- meta | doc:G2 | section:S2 | breadcrumb:B -->
<!-- meta | doc:G3 | section:S3 -->
## Beta

{b}

| Level | Fee |
|---|---|
| One | 10 |
| Two | 20 |

tail
### Gamma
[IMAGE:x.png]
{c}
""".format(a="word " * 60, b="other " * 50, c="gone " * 80)


def test_sections_meta_and_chunks(spark):
    df = spark.createDataFrame([(1, DOC, "T", "U"), (2, None, None, None), (3, "no heading", None, None), (4, "# Only\n\n" + "x " * 150, "T4", "U4")], "doc_id long, text string, doc_title string, source_url string")
    s = split_sections(df, "doc_id", "text")
    got = [(r["heading"], r["content"], r["meta"]) for r in s.where("doc_id = 1").orderBy("section_no").collect()]
    assert got == plain_sections(DOC)
    m = with_metadata(s.where("doc_id = 1"), F.lit("T"), F.lit("U")).orderBy("section_no").collect()
    assert [(r["chunk_doc"], r["section"], r["breadcrumb"]) for r in m] == [("G1", "S1", "G1 > S1"), ("G3", "S3", "T > Beta"), ("T", "Gamma", "T > Gamma")]
    chunks = document_chunks(df, "doc_id", "text", "doc_title", "source_url").orderBy("doc_id", "ord").collect()
    kinds = [(r["doc_id"], r["chunk_type"], r["heading"]) for r in chunks]
    assert kinds == [(1, "section_index", "Section Index: Guide"), (1, "text", "Alpha"), (1, "text", "Beta"), (4, "section_index", "Section Index: T4"), (4, "text", "Only")]
    assert all(r["chunk_id"] == hashlib.md5(r["content"].encode()).hexdigest()[:12] for r in chunks)
    assert all(r["token_count"] == len(r["content"]) // 4 for r in chunks)
    assert chunks[1]["parent_doc"] == "Guide" and chunks[1]["source_url"] == "https://x.example/1"


def test_table_chunks_keep_whole_tables(spark):
    rows = "\n".join(f"| row {i} | {i * 7} |" for i in range(60))
    df = spark.createDataFrame([(1, "# T\n\nintro " + "word " * 60 + "\n\n| Name | Value |\n|---|---|\n" + rows, None, None)], "doc_id long, text string, doc_title string, source_url string")
    got = document_chunks(df, "doc_id", "text", "doc_title", "source_url").where("chunk_type <> 'section_index'").orderBy("ord").collect()
    assert [r["chunk_type"] for r in got] == ["text", "table"]
    assert got[1]["content"].startswith("Name | Value\nName: row 0, Value: 0")


def test_other_sources_and_shared_ids(spark):
    img = spark.createDataFrame([("a.png", "D", "S", "B", "U", None, "shown text", False, "image_text", "ocr"), ("b.png", "D", "S", "B", "U", "before", None, None, None, None), ("c.png", "D", "S", "B", "U", None, "x", True, None, None), ("d.png", "D", "S", "B", "U", None, None, None, None, None)], "filename string, doc_title string, section string, breadcrumb string, source_url string, surrounding_before string, image_content string, is_decorative boolean, chunk_type string, scan_method string")
    got = {r["src"]: r["content"] for r in image_chunks(img).collect()}
    assert got == {"a.png": "[Image: a.png]\nSection: S\n\nshown text", "b.png": "[Image: b.png]\nSection: S\nContext: before"}
    link = spark.createDataFrame([("https://e.example/a", "t", "T", "what", "when", "cat", "public", "D", "S", "B")], "url string, link_text string, title string, what_it_contains string, when_to_refer string, category string, access string, found_in_doc string, section string, breadcrumb string")
    closed = spark.createDataFrame([("https://e.example/a", "login", "D", "S", "B", None, "note")], "url string, skip_reason string, found_in_doc string, section string, breadcrumb string, surrounding_text string, note string")
    both = first_wins(union_chunks(reference_link=link_chunks(link), restricted_doc=restricted_chunks(closed)), "chunk_id", "source_rank").collect()
    assert len(both) == 1 and both[0]["chunk_type"] == "reference_link"


def test_fusion_and_fallback(spark):
    d = spark.createDataFrame([(1, "a", 900_000, 1), (1, "b", 500_000, 2)], "q int, p string, score long, rank int")
    s = spark.createDataFrame([(1, "b", 400_000, 1), (1, "c", 200_000, 2)], "q int, p string, score long, rank int")
    got = [(r["p"], r["fused"], r["raw"]) for r in fuse(d, s, "q", "p").orderBy("rank").collect()]
    assert got == [("a", 6_300_000, 900_000), ("b", 4_700_000, 500_000), ("c", 600_000, 200_000)]
    low = spark.createDataFrame([(1, "a", 2_000_000), (2, "a", 2_000_000), (3, "a", 5_000_000)], "q int, p string, fused long")
    broad = spark.createDataFrame([(1, "z", 2_500_000), (2, "z", 2_000_000), (3, "z", 9_000_000)], "q int, p string, fused long")
    assert {(r["q"], r["p"], r["branch"]) for r in with_fallback(low, broad, "q").collect()} == {(1, "z", "broad"), (2, "a", "first"), (3, "a", "first")}


def test_expand_references(spark):
    top = spark.createDataFrame([(1, "a")], "q int, p string")
    chunks = spark.createDataFrame([("a", "S0", ["S1", "S2", "S3", "S4"]), ("b", "S1", None), ("c", "S4", None), ("d", "S2", []), ("a2", "S0", None)], "p string, section string, `references` array<string>")
    assert {r["p"] for r in expand_references(top, chunks, "q", "p").collect()} == {"b", "d"}


def test_crawl_cycles_and_number_rows(spark):
    e = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("r", "c"), ("x", "y")], "s string, t string")
    roots = spark.createDataFrame([("r",), (None,)], "n string")
    assert {(r["node"], r["level"]) for r in crawl_levels(e, roots, "s", "t").collect()} == {("r", 0), ("a", 1), ("c", 1), ("b", 2)}
    df = spark.range(1000).withColumn("o", (F.col("id") * 7919) % 1000)
    got = number_rows(df, "o", "n").orderBy("o").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert number_rows(df.where("id < 0"), "o", "n").count() == 0


def test_conversation(spark):
    rows = spark.createDataFrame([(1, 0, "user", "u0"), (1, 1, "assistant", "a1"), (1, 2, "user", ""), (1, 3, "assistant", None), (1, 4, "user", "u4")], "k int, turn int, role string, content string")
    assert {r["turn"] for r in conversation.last_turns(rows, "k", 2).collect()} == {1, 4}
    asked = {r["turn"]: r["asked"] for r in conversation.last_user_message(rows, "k").collect()}
    assert asked == {0: None, 1: "u0", 2: "u0", 3: "", 4: ""}
    assert conversation.next_id(rows, "k", "turn").first()["next_id"] == 5
    lines = spark.createDataFrame([("r", 3, 'data: {"type":"token","text":"b"}\n\n'), ("r", 1, 'data: {"type":"token","text":"a"}'), ("r", 4, "data: {broken"), ("r", 5, "noise"), ("r", 6, 'data: {"type":"sources","text":"s1"}'), ("r", 7, 'data: {"type":"sources","text":"s2"}')], "k string, seq int, line string")
    assert conversation.fold_events(lines, "k").first().asDict() == {"k": "r", "answer": "ab", "sources": "s2"}


def test_incremental_and_quality(spark):
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v int")
    assert {(r["k"], r["status"]) for r in incremental.reuse(new, old, "k", "v").collect()} == {("a", "done"), ("b", "todo"), ("c", "todo")}
    t = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "k string, o int, v string")
    b = spark.createDataFrame([("a", 1, "new"), ("b", 0, "new"), ("c", 0, "new")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in incremental.upsert(t, b, "k", "o").collect()} == {("a", "new"), ("b", "old"), ("c", "new")}
    v = spark.createDataFrame([([1.0, 0.0],), (None,), ([1.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([None, 1.0],)], "v array<double>")
    assert quality.embedding_report(v, "v", 2).first().asDict() == {"n_rows": 6, "n_missing": 1, "n_wrong_length": 1, "n_not_finite": 2, "n_zero": 1}


def test_html(spark):
    page = "<html><head><title>T &amp; U</title><script>x</script></head><body><nav><a href='/n'>n</a></nav><h1>Head</h1><p>one<p>two <a href='/x'>link <b>text</b></a><br>three<table><tr><th>A</th><th>B</th></tr><tr><td>1|2</td></tr></table><ul><li>i1<li>i2</ul>"
    r = html.extract(spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, h string"), "k", "h").orderBy("k").collect()
    assert r[0]["title"] == "T & U" and [(x["href"], x["text"]) for x in r[0]["links"]] == [("/x", "link text")]
    assert r[0]["markdown"] == "# Head\n\none\n\ntwo link text three\n\n| A | B |\n|---|---|\n| 1\\|2 |  |\n\n- i1\n\n- i2"
    assert r[1]["markdown"] == "" and r[2]["links"] == []


def test_web_crawl_keeps_rejects_and_fetches_once(spark):
    def fetch(u):
        pages = {"r": (200, "a b"), "a": (200, "r c"), "b": (401, ""), "c": (200, "Sign in")}
        if u not in pages:
            raise OSError("connection refused")
        return pages[u]

    links = lambda pages: pages.select(F.explode(F.split("html", " ")).alias("url"))
    got = {(r["url"], r["level"], r["reason"]) for r in web.crawl(spark.createDataFrame([("r",)], "u string"), fetch, links).collect()}
    assert got == {("r", 0, None), ("a", 1, None), ("b", 1, "login required"), ("c", 2, "login wall")}
    assert web.judge(503, "") == "status 503"


def test_type_counts_cover_all_rows_and_absent_types(spark):
    rows = spark.createDataFrame([("text", None), ("text", "T"), ("table", "T")], "chunk_type string, doc_title string")
    got = {r["chunk_type"]: r["n"] for r in quality.counts_by_type(rows).collect()}
    assert got == {"text": 2, "table": 1, "image": 0, "reference_link": 0, "restricted_doc": 0, "section_index": 0}


def test_crawls_have_no_depth_limit_and_end_loudly_at_a_given_one(spark, monkeypatch):
    monkeypatch.setattr("marlstone.operators.links.CUT_EVERY", 2, raising=False)
    links = lambda pages: pages.select("html").toDF("url")
    fetch = lambda u: (200, str(int(u) + 1) if int(u) < 5 else "0")
    start = spark.createDataFrame([("0",)], "u string")
    e = spark.createDataFrame([(str(i), str((i + 1) % 6)) for i in range(6)], "s string, t string")
    want = [(str(i), i) for i in range(6)]
    assert sorted((r["url"], r["level"]) for r in web.crawl(start, fetch, links).collect()) == want
    assert sorted((r["node"], r["level"]) for r in crawl_levels(e, start, "s", "t").collect()) == want
    assert web.crawl(start, fetch, links, 6).count() == crawl_levels(e, start, "s", "t", 6).count() == 6
    with pytest.raises(RuntimeError):
        web.crawl(start, fetch, links, 5)
    with pytest.raises(RuntimeError):
        crawl_levels(e, start, "s", "t", 5)


def test_files(spark, tmp_path):
    assert files.read_json_table(spark, str(tmp_path / "none.json"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_json_table(spark, str(tmp_path / "none.json"), "a int", required=True)
    (tmp_path / "x.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert files.read_json_table(spark, str(tmp_path / "x.json"), "a int").count() == 2
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/sub/p.md").write_text("# x\ny")
    assert files.read_markdown(spark, str(tmp_path / "docs")).first()["text"] == "# x\ny"
    pics = spark.createDataFrame([(2, b"zz", "png"), (1, b"aa", "jpg"), (3, b"aa", "jpg")], "o int, content binary, ext string")
    assert [r["file"] for r in files.image_names(pics, "o", "ext").orderBy("o").collect()] == ["img_001.jpg", "img_002.png"]
    uri = spark.createDataFrame([("data:image/png;base64,aGk=",), ("data:x,%%%",)], "s string")
    assert [r[0] for r in uri.select(files.inline_image("s")).collect()] == [bytearray(b"hi"), None]


def test_stream_upserts_once(spark, tmp_path):
    src, target, check = (str(tmp_path / x) for x in ("src", "target", "check"))
    schema = "k string, o int, v string"
    for i, rows in enumerate(([("a", 1, "x"), ("b", 1, "x")], [("a", 2, "y"), ("c", 1, "y")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):  # the second run has nothing left to do
            ingest.upsert_stream(ingest.read_stream(spark, src, schema), target, check, "k", "o").awaitTermination(120)
    assert {(r["k"], r["v"]) for r in ingest.current_table(spark, target).collect()} == {("a", "y"), ("b", "x"), ("c", "y")}


def test_lineage_cut_and_settings(spark):
    df = cut_lineage(spark.range(5).where("id > 10"))
    assert df.count() == 0 and df.columns == ["id"]
    assert DEFAULTS.validate() == [] and Settings(min_tokens=600).validate() == ["min_tokens"]


def test_provider_chain(spark):
    def broken(p):
        raise OSError("rate limit reached")

    def fatal(p):
        raise ValueError("bad request")

    df = spark.createDataFrame([("hello",)], "p string")
    r = df.select(complete(F.col("p"), [("one", broken), ("two", str.upper)]).alias("r")).first()["r"]
    assert (r["text"], r["model"], r["error"]) == ("HELLO", "two", None)
    r = df.select(complete(F.col("p"), [("one", fatal), ("two", str.upper)]).alias("r")).first()["r"]
    assert r["text"] is None and "bad request" in r["error"]
    assert hashed_embedder(8)(["", "a b"])[0] == [0.0] * 8


def test_engine_answers(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    e = Engine(spark)
    chunks = e.build_index(docs, spark.read.parquet(f"{small}/image_metadata.parquet"), spark.read.parquet(f"{small}/reference_links.parquet"), spark.read.parquet(f"{small}/restricted_links.parquet"))
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 50
    q = spark.createDataFrame([("1", "Which office releases the survey plot?", []), ("2", "hello you", None)], "id string, question string, history array<struct<role: string, content: string>>")
    got = {r["id"]: r for r in e.ask(q).collect()}
    assert got["2"]["branch"] == "off_topic" and got["1"]["context"] and got["1"]["answer"]
    events = [json.loads(x[6:]) for x in e.stream_answer("Which office releases the survey plot?")]
    assert [x["type"] for x in events][0] == "status" and events[-1]["type"] == "done"


def test_no_reference_to_the_optional_subpackage():
    root = Path(__file__).resolve().parents[1] / "marlstone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


def test_contents_and_numbers(spark):
    page = "<ul><li><a href='#h.a'>1.2 Fees</a><li><a href='#h.b'>Plain</a><li><a href='#h.a'>1.3 Fees again</a><li><a href='/x?y#z'>out</a></ul><p>near <a href='/x'>out2</a></p>"
    out = html.extract(spark.createDataFrame([(1, page)], "k int, h string"), "k", "h")
    toc = out.select("k", F.inline(html.contents(F.col("links"))))
    assert {(r["anchor"], r["number"], r["title"], r["level"]) for r in toc.collect()} == {("h.b", "", "Plain", 1), ("h.a", "1.3", "1.3 Fees again", 2)}
    hs = spark.createDataFrame([(1, "h.a", "Fees"), (1, "h.z", "None")], "k int, a string, title string")
    assert {(r["title"], r["number"]) for r in html.number_headings(hs, toc, "a", "k").collect()} == {("Fees", "1.3"), ("None", None)}
    assert out.select(F.element_at("links", -1)["around"]).first()[0] == "near out2"
    assert {r["url"] for r in html.document_links(out, "k").collect()} == {"/x?y", "/x"}
    assert quality.question_run_stats(spark.createDataFrame([(["a", "b"],), ([],), (None,)], "q array<string>"), "q").first().asDict() == {"generated": 1, "failed": 2, "total_questions": 2}
