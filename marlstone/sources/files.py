"""Reading and writing the pipeline's tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage

UNSAFE = re.compile(r"[^\w.\-]")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_json_table(spark: SparkSession, path: str, schema: str, *, required: bool = False) -> DataFrame:
    """A table kept as one file with a JSON array, or as a folder of JSON lines as :func:`write_json_table` makes it.

    A file is one task, a folder splits.  A missing path is an empty table, or an error if it is required.
    """
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
    return spark.read.schema(schema).option("multiLine", is_file).json(path)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of all markdown files below a folder."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_json_table(df: DataFrame, path: str) -> None:
    """A folder of JSON lines; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """One file per row, written by the executors straight into a shared folder; gives (name, path, bytes), written once.

    Names are made safe for a file system.  A task that runs again writes the same files again.  Null contents give
    empty files; rows of one name would overwrite each other, so names must be unique.
    """
    root = folder if "://" in folder else "file://" + folder

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        for pdf in batches:
            rows = []
            for n, c in zip(pdf["n"], pdf["c"]):
                raw = b"" if c is None else c.encode() if isinstance(c, str) else bytes(c)
                path = f"{base}/{UNSAFE.sub('_', n)}"
                with system.open_output_stream(path) as out:
                    out.write(raw)
                rows.append((n, path, len(raw)))
            yield pd.DataFrame(rows, columns=["name", "path", "bytes"])

    return cut_lineage(df.where(F.col(name).isNotNull()).select(F.col(name).alias("n"), F.col(content).alias("c")).mapInPandas(run, "name string, path string, bytes bigint"))


def write_markdown(docs: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """One markdown file per document; see :func:`write_files`."""
    return write_files(docs.withColumn("_f", F.concat(F.col(name).cast("string"), F.lit(".md"))), folder, "_f", text)


#: Fields that filters on the collection name: keywords, and a number.
INDEXED, ORDERED = ("doc_title", "parent_doc", "section", "access"), "heading_level"


def write_points(df: DataFrame, path: str, by: str = "chunk_type") -> None:
    """The collection: dropped and made anew, in folders by type so that filters on the type read no other files.

    The other indexed fields have Bloom filters in the files, the number is sorted inside them; absent fields are skipped.
    """
    out = df.sortWithinPartitions(by, ORDERED) if ORDERED in df.columns else df
    writer = out.write.mode("overwrite").partitionBy(by)
    for c in INDEXED:
        if c in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def image_names(images: DataFrame, order: str, extension: str) -> DataFrame:
    """Adds ``file``: numbered names for pictures kept once by the hash of their bytes."""
    from ..operators.chunking import first_wins
    from ..operators.numbering import number_rows

    kept = first_wins(images.withColumn("image_hash", F.md5("content")), "image_hash", order)
    return number_rows(kept, order, "n").withColumn("file", F.format_string("img_%03d.%s", F.col("n"), F.col(extension))).drop("n")


def image_extension(content_type: str):
    """File ending by content type."""
    c = F.lower(content_type)
    return F.when(c.contains("jpeg") | c.contains("jpg"), "jpg").when(c.contains("gif"), "gif").when(c.contains("webp"), "webp").otherwise("png")


def inline_image(src: str):
    """Bytes of a data URI; null if it cannot be read."""
    return F.try_to_binary(F.substring_index(F.col(src), ",", -1), F.lit("base64"))
