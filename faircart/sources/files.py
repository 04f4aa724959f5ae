"""Files as relations and relations as files: JSON documents, lines, ledgers, training sets, reports, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import free_name


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file, with ``folder`` to join what lies together; a broken file is a row with ``_corrupt``."""
    rows = spark.read.schema(f"{schema}, _corrupt string").json(path, multiLine=True, recursiveFileLookup=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1))


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object per line; blank lines are dropped. Broken lines fail, or are kept in ``_corrupt``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(f"{schema}, _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def read_ledger(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated ledger whose header must be exactly ``columns`` and whose rows must all be as wide."""
    header = spark.read.text(path, wholetext=False).limit(1).first()
    if header is None or header.value.split("\t") != columns:
        raise ValueError(f"the header of {path} differs from the {len(columns)} columns expected")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, sep="\t", header=True, enforceSchema=False, mode="FAILFAST", quote="")


def replay_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages under ``path``: ``(folder, html, page, blocked)`` of every ``main.html`` with its ``page.json``, unless it was blocked.

    A page description that is no JSON gives null fields, never a failed task.
    """
    folder = F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]*$", 1)
    html = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="main.html").select(folder.alias("folder"), F.col("value").alias("html"))
    page = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="page.json").select(folder.alias("folder"), F.col("value").alias("page"))
    rows = html.join(page, "folder", "left").withColumn("blocked", F.coalesce(F.get_json_object("page", "$.blocked") == "true", F.lit(False)))
    return rows.where(~F.col("blocked"))


def provenance(files: DataFrame, by: list[str], name: str, content: str) -> DataFrame:
    """``(by, files, bytes, sha256)``: the digest of each group's files, of lines name, size and digest in the order of names.

    A group is the files of one page's folder, so its list is short.
    """
    digest, size = F.sha2(F.col(content).cast("binary"), 256), F.octet_length(F.col(content).cast("binary"))
    each = files.select(*by, F.col(name).alias("name"), size.alias("size"), digest.alias("digest"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("name", "size", "digest"))), lambda f: F.concat(f["name"], F.lit("\0"), f["size"].cast("string"), F.lit("\0"), f["digest"], F.lit("\n")))
    return each.groupBy(*by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sha2(F.array_join(listed, ""), 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """``(key, change)`` of files that were added, removed or changed."""
    both = before.select(key, F.col(digest).alias("a")).join(after.select(key, F.col(digest).alias("b")), key, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def write_training_set(records: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Writes records as JSON lines by split, and returns the manifest: counts and an order-free digest of each split."""
    text = F.to_json(F.struct(*(c for c in records.columns if c != split)))
    lines = records.select(F.col(split), text.alias("value"))
    lines.write.mode("overwrite").partitionBy(split).text(path)
    written = records.sparkSession.read.text(path)
    digest = F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return written.groupBy(split).agg(F.count("*").alias("records"), digest.alias("digest"))


def write_report(rows: DataFrame, path: str) -> None:
    """A small aggregated table as JSON lines in one file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def with_release(records: DataFrame, image: Column, release: str) -> DataFrame:
    """Public records: an image address and where they come from."""
    return records.withColumn("image", image).withColumn("provenance", F.struct(F.lit(release).alias("release"), F.lit("synthetic").alias("origin")))


def selection_digest(records: DataFrame, by: list[str], key: str) -> DataFrame:
    """Digest of the keys of each (short) group in order, so that two selections can be compared."""
    name = free_name(records, "keys")
    listed = records.groupBy(*by).agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias(name))
    return listed.select(*by, F.sha2(F.array_join(name, "\n"), 256).alias("digest"))


def first_capture(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def png_size(content: Column) -> Column:
    """``struct<width, height>`` from the header of a PNG file's bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 24))
    number = lambda at: F.conv(F.substring(head, 2 * at + 1, 8), 16, 10).cast("long")
    formed = head.rlike("^89504E470D0A1A0A[0-9A-F]{8}49484452[0-9A-F]{16}$")
    return F.when(formed & (number(16) > 0) & (number(20) > 0), F.struct(number(16).alias("width"), number(20).alias("height")))


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, name, size)`` of all PNG files under ``path``; ``size`` is null for a broken one. Only sizes leave the scan."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    return rows.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), png_size(F.col("content")).alias("size"))


def fits_region(size: Column, width: Column, height: Column, most: float = 2.0) -> Column:
    """Whether a picture is as large as its region, within ``most`` pixels; a picture without a size never is."""
    return F.coalesce((F.abs(size["width"] - width) <= most) & (F.abs(size["height"] - height) <= most), F.lit(False))
