"""Files, streams, the crawl, pictures and what is kept in the shared folder."""

import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone import lineage
from marlstone.functions.text import heading_line
from marlstone.models import plain_reader, read_images
from marlstone.operators import conversation, html, images, incremental
from marlstone.sources import files, web
from marlstone.streaming import ingest


def test_json_tables_read_back_what_was_written(spark, tmp_path):
    schema = "k string, n int, xs array<string>"
    rows = [(f"k{i}", None if i == 3 else i, ["a", "ü"] if i % 2 else None) for i in range(5)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    files.write_json_table(df, f"file://{tmp_path}/t")
    assert sorted(map(tuple, files.read_json_table(spark, f"file://{tmp_path}/t", schema).collect())) == sorted(rows)
    Path(tmp_path / "one.json").write_text('[{"k": "a", "n": 1}, {"k": "b", "xs": ["c"]}]')
    assert [tuple(r) for r in files.read_json_table(spark, f"file://{tmp_path}/one.json", schema).orderBy("k").collect()] == [("a", 1, None), ("b", None, ["c"])]
    assert files.read_json_table(spark, f"file://{tmp_path}/none", schema).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_json_table(spark, f"file://{tmp_path}/none", schema, required=True)


def test_files_are_written_one_per_row(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "# x ü"), ("c", None), (None, "lost")], "n string, t string")
    out = files.write_markdown(df, str(tmp_path / "md"), "n", "t")
    assert {(r["name"], r["bytes"]) for r in out.collect()} == {("a/b.md", 6), ("c.md", 0)}
    assert (tmp_path / "md" / "a_b.md").read_text() == "# x ü"
    back = files.read_markdown(spark, f"file://{tmp_path}/md")
    assert [r["text"] for r in back.collect()] == ["# x ü"]  # an empty file gives no row


def test_points_are_pruned_by_type_and_have_filters(spark, tmp_path):
    df = spark.createDataFrame([("text", "d", 2), ("image", "e", 1)], "chunk_type string, doc_title string, heading_level int")
    files.write_points(df, f"file://{tmp_path}/p")
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["chunk_type=image", "chunk_type=text"]
    assert spark.read.parquet(f"file://{tmp_path}/p").where("doc_title = 'e'").count() == 1


def test_cuts_end_with_their_scope(spark):
    with lineage.scope() as keep:
        a = lineage.cut_lineage(spark.range(3).toDF("x"))
        with lineage.scope() as inner:
            b = inner(a.withColumn("y", F.col("x") + 1))
        path_a, path_b = (Path(df.inputFiles()[0].removeprefix("file://")) for df in (a, b))
        c = keep(b)
        path_c = Path(c.inputFiles()[0].removeprefix("file://"))
        assert path_a.exists() and path_b.exists()
    assert not path_a.exists() and not path_b.exists() and path_c.exists() and c.count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://x:7077", "app"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())
    Context.getCheckpointDir = staticmethod(lambda: "hdfs://shared/")
    assert lineage.shared_dir(Session()) == "hdfs://shared"


def test_upserts_touch_only_their_buckets_and_repeat(spark, tmp_path):
    src, target, check = (f"file://{tmp_path}/{x}" for x in ("in", "t", "c"))
    schema = "k string, v string, o int"
    assert ingest.current_table(spark, target, schema).count() == 0
    for rows in ([("a", "x", 1), ("b", "x", 1), (None, "n", 1)], [("a", "y", 2), ("a", "old", 0), ("c", "y", 2)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        ingest.upsert_stream(ingest.read_stream(spark, src, schema), target, check, "k", "o", 16).awaitTermination(120)
    got = {(r["k"], r["v"]) for r in ingest.current_table(spark, target).collect()}
    assert got == {("a", "y"), ("b", "x"), ("c", "y"), (None, "n")}
    before = ingest._versions(spark, target)
    assert len({v.split("/")[-2] for v in before.values()}) == 2  # the second batch left the buckets of b and null alone
    assert ingest.vacuum(spark, target) >= 1 and ingest._versions(spark, target) == before
    assert {(r["k"], r["v"]) for r in ingest.current_table(spark, target).collect()} == got


def test_late_rows_and_windows_as_a_stream(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a"), ("2024-01-01 10:50:00", "a"), ("2024-01-01 11:00:00", "b")]
    df = spark.createDataFrame(rows, "s string, e string").select(F.col("s").cast("timestamp").alias("ts"), "e")
    df.write.parquet(f"file://{tmp_path}/in")
    stream = ingest.tumbling_counts(ingest.read_stream(spark, f"file://{tmp_path}/in", "ts timestamp, e string"), "ts", "e")
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["hour"].hour, r["e"], r["n"]) for r in spark.table("windows").collect()) == [(10, "a", 2), (11, "b", 1)]
    assert sorted((r["hour"].hour, r["e"], r["n"]) for r in ingest.tumbling_counts(df, "ts", "e").collect()) == [(10, "a", 2), (11, "b", 1)]


SITE = {"r": ["a", "b", "x"], "a": ["c"], "b": ["a", "d"], "c": ["r"], "d": []}


def _fetch(log):
    def fetch(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        if url not in SITE:
            raise OSError("gone away")
        return 200, "".join(f"<a href='{x}'>" for x in SITE[url])

    return fetch


def _links(pages):
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit("href='([^']*)'"), 1)).alias("url"))


def test_a_broken_crawl_goes_on(spark, tmp_path):
    log, state = tmp_path / "log", f"file://{tmp_path}/state"
    roots = spark.createDataFrame([("r",)], "u string")
    with pytest.raises(RuntimeError):
        web.crawl(roots, _fetch(log), _links, 2, state=state)
    first = log.read_text().split()
    pages = web.crawl(roots, _fetch(log), _links, state=state, follow=lambda u: u != "d")
    assert sorted((r["url"], r["level"], r["reason"]) for r in pages.collect() if r["url"] != "d") == [("a", 1, None), ("b", 1, None), ("c", 2, None), ("r", 0, None), ("x", 1, "gone away")]
    assert not set(log.read_text().split()[len(first) :]) & set(first)  # nothing is fetched twice
    links = spark.createDataFrame([("x", "G", "S", "B", "u", "t", 2), ("x", "F", "S", "B", "u", "t", 1), ("a", "F", "S", "B", "u", "t", 1)], "url string, found_in_doc string, section string, breadcrumb string, source_url string, surrounding_text string, o int")
    got = web.restricted_links(links, pages, "o").collect()
    assert [(r["url"], r["found_in_doc"], r["skip_reason"], r["access"]) for r in got] == [("x", "F", "gone away", "restricted")]


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_dimensions():
    assert images.dimensions_of(png(300, 20)) == (300, 20)
    assert images.dimensions_of(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9)
    assert images.dimensions_of(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 40, 60) + b"\x03") == (60, 40)
    assert images.dimensions_of(b"RIFF0000WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == (100, 50)
    assert images.dimensions_of(b"") is None and images.dimensions_of(b"\xff\xd8\xff") is None and images.dimensions_of(b"text") is None


def test_pictures_of_a_page(spark):
    page = """<div id="header"><p>menu</p><div><img src="logo.png"></div></div><div><h2>Fees</h2><p>First text.</p><ul><li>item</li></ul>
    <p>lost words <img src="a.png" alt="A"> <img src="b.png"></p><li>After item</li><h2>Next</h2><p><img src="data:image/gif;base64,QUJD"></p></div>"""
    out = html.extract(spark.createDataFrame([(1, page), (2, None)], "k int, h string"), "k", "h")
    pics = images.page_images(out, "k").orderBy("pos").collect()
    assert [(r["src"][:10], r["section"], r["before"], r["after"]) for r in pics][0] == ("a.png", "Fees", "First text.", "After item")
    assert [r["section"] for r in pics][-1] == "Next" and "menu" not in out.where("k = 1").first()["markdown"]
    rows = images.fetch_images(images.page_images(out, "k").withColumn("o", F.col("pos")), "src", lambda u: ("image/jpeg", b"jpeg bytes") if u == "a.png" else 1 / 0).orderBy("pos").collect()
    assert [(r["extension"], bytes(r["content"]) if r["content"] else None) for r in rows][0] == ("jpg", b"jpeg bytes") and bytes(rows[-1]["content"]) == b"ABC" and rows[-1]["extension"] == "gif"
    plain = images.fetch_images(images.page_images(out, "k"), "src")
    records = images.image_records(plain.withColumn("o", F.col("pos")), "o").collect()
    assert [(r["filename"], r["file_size_kb"], r["section"]) for r in records] == [("img_001.gif", 0.0, "Next")]


def test_reading_pictures_goes_on(spark):
    df = spark.createDataFrame([("a", b"text of a"), ("b", b"\xff\xfe"), ("c", None)], "f string, c binary")
    got = {r["f"]: (r["r"]["text"], r["r"]["error"]) for r in df.select("f", read_images(F.col("c"), plain_reader).alias("r")).collect()}
    assert got == {"a": ("text of a", None), "b": ("", None), "c": (None, "no content")}
    table = spark.createDataFrame([("a", None, None, None, None, None), ("b", "old", "image_text", False, "ocr", False), ("c", None, None, None, None, True)], "f string, image_content string, chunk_type string, is_decorative boolean, scan_method string, needs_ocr boolean")
    assert [r["f"] for r in incremental.scans_todo(table).orderBy("f").collect()] == ["a", "c"]
    results = spark.createDataFrame([("a", "new", "image_text", False, "ocr")], "f string, content string, chunk_type string, is_decorative boolean, scan_method string")
    done = incremental.scans_done(table, results, "f").orderBy("f").collect()
    assert [(r["f"], r["image_content"], r["needs_ocr"]) for r in done] == [("a", "new", False), ("b", "old", False), ("c", None, True)]


def test_tables_name_their_section_when_asked(spark):
    page = "<h2>Fees</h2><table><tr><th>Level</th><th>Fee</th></tr><tr><td>One | two</td><td>10</td></tr></table>"
    df = spark.createDataFrame([(1, page)], "k int, h string")
    plain, named = (html.extract(df, "k", "h", annotate=a).first()["markdown"] for a in (False, True))
    assert named == plain.replace("| Level", "> *Table from section: **Fees***\n\n| Level") and named != plain and "One \\| two" in plain


def test_questions_are_rewritten_and_expanded(spark):
    df = spark.createDataFrame([(1, "And the fee?", [("user", "What is Optics?"), ("assistant", "A course.")]), (2, "When is it?", None)], "id int, question string, history array<struct<role: string, content: string>>")
    ask = lambda **kw: {r["id"]: r["s"] for r in df.select("id", conversation.standalone(F.col("history"), F.col("question"), **kw).alias("s")).collect()}
    assert ask()[1].endswith("Question: And the fee?") and ask()[2] == "When is it?"
    assert ask(providers=[("m", lambda p: " rewritten ")]) == {1: "rewritten", 2: "rewritten"}
    assert ask(providers=[("m", lambda p: 1 / 0)]) == {1: "And the fee?", 2: "When is it?"}
    assert ask(hints={"WHEN IS": "date time"})[2] == "When is it? date time" and ask(hints={"x y": "z"})[2] == "When is it?"


def test_headings_are_numbered_by_their_anchors(spark):
    page = """<p><a href="#h.a">1 Fees</a> <a href="#h.b">1.1 Dates</a> <a href="#h.c">2 Exams</a></p>
    <h1 id="h.a">Fees</h1><h2><span id="h.b"></span>1.1 Dates</h2><h1><a id="h.c">Exams</a></h1><h2>Free</h2>"""
    out = html.extract(spark.createDataFrame([(1, page)], "k int, h string"), "k", "h")
    toc = out.select("k", F.inline(html.contents(F.col("links"))).alias("anchor", "number", "title", "level")).select("k", "anchor", "number")
    found = html.number_headings(out.select("k", F.inline("headings")), toc, "anchor", "k").orderBy("pos")
    lines = [r["line"] for r in found.select(heading_line(F.col("level"), F.col("title"), F.col("number")).alias("line")).collect()]
    assert lines == ["# 1 Fees", "## 1.1 Dates", "# 2 Exams", "## Free"]
