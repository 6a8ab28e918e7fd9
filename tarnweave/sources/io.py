"""Readers and writers: record files, record tables, and versioned index artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.operators.index import SearchIndex
from tarnweave.schemas import CRAWL_RECORD, require, with_defaults


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Crawl records from files with one JSON object per line.

    Blank lines are skipped and unknown fields ignored. With ``strict`` an undecodable line, or
    one without a required field, fails the whole read.
    """
    return with_defaults(require(spark.read.schema(CRAWL_RECORD).json(path, mode="FAILFAST")) if strict else spark.read.schema(CRAWL_RECORD).json(path))


def decode_records(table: DataFrame, column: str = "record_json") -> DataFrame:
    """Crawl records from a table with JSON in a column; rows without any are skipped, bad JSON is fatal."""
    decoded = table.where(F.col(column).isNotNull()).select(F.from_json(column, CRAWL_RECORD, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return with_defaults(require(decoded))


def encode_records(records: DataFrame) -> DataFrame:
    """One JSON object per record, absent values written as null."""
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in CRAWL_RECORD.fields]
    return records.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record_json"))


def append_records(records: DataFrame, path: str) -> None:
    """Appends; a run that is repeated appends its records again."""
    encode_records(records).write.mode("append").text(path)


def write_contents(contents: DataFrame, path: str) -> None:
    """Appends contents(content_hash, html) that the store at ``path`` doesn't have."""
    spark = contents.sparkSession
    new = contents.dropDuplicates(["content_hash"])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("content_hash"), "content_hash", "left_anti")
    new.write.mode("append").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced in one step: written beside, then renamed over the one before."""
    fs, final = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    beside = hadoop.Path(final.getParent(), f".{final.getName()}.next")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    at = fs.makeQualified(final)
    hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), at, overwrite)


_PARTS = ("documents", "postings", "terms", "stats")


def write_index(index: SearchIndex, root: str, version: int) -> str:
    """Writes the tables under versions/<version>, then points ``active`` at them.

    Postings carry the length and rank of their document and are sorted by term, documents by id, so that a search
    reads few row groups of either. The pointer is a small file that is replaced last, in one
    step: a reader sees the old version or the new one.
    """
    at = f"{root}/versions/{version}"
    for name in _PARTS:
        df = getattr(index, name)
        if name == "postings":
            df = df.join(index.documents.select("id", "token_count", "page_rank"), "id").select("term", "id", "tf", "token_count", "page_rank")
            df = df.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        elif name == "documents":
            df = df.repartitionByRange("id").sortWithinPartitions("id")
        df.write.mode("errorifexists").parquet(f"{at}/{name}")
    write_file(index.documents.sparkSession, f"{root}/active.json", json.dumps({"version": version}))
    return at


def active_version(spark: SparkSession, root: str) -> int:
    return json.loads("".join(r.value for r in spark.read.text(f"{root}/active.json").collect()))["version"]  # one line


def read_index(spark: SparkSession, root: str, version: int | None = None) -> SearchIndex:
    """The tables of the active version, or of a given one."""
    v = active_version(spark, root) if version is None else version
    return SearchIndex(*[spark.read.parquet(f"{root}/versions/{v}/{name}") for name in _PARTS])


def export_index_json(index: SearchIndex, path: str) -> None:
    """The interchange form: one JSON object per document, with its term map."""
    freqs = index.postings.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("term_freqs"))
    index.documents.join(freqs, "id", "left").write.mode("overwrite").json(path)
