"""Readers of corpus files: JSON units in three layouts, segment maps, plain volumes, markup, SQLite pages, lexicon YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENT = "struct<lemma:string,pos:string,root:string,word:string,verb:string>"
TOKEN = f"struct<word:string,lemma:string,pos:string,root:string,sandhi:array<string>,components:array<{COMPONENT}>>"
SEGMENTS = f"array<struct<id:string,pali:string,text:string,tokens:array<{TOKEN}>>>"
GROUP = f"array<struct<id:string,segments:{SEGMENTS}>>"
UNIT = f"id string, title string, name string, vagga string, segments {SEGMENTS}, suttas {GROUP}, items {GROUP}, texts {GROUP}"


def read_units(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """``(collection, file, unit_id, unit_ord, segments)`` of a folder of JSON files in any of the layouts.

    A file holds one unit, or groups of them in one of three arrays. Names that begin with ``_`` are skipped.
    Units are ordered by file name, then place in the file.
    """
    raw = spark.read.schema(UNIT).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    inner = F.coalesce("suttas", "items", "texts", F.array(F.struct("id", "segments")))
    rows = raw.select(F.lit(collection).alias("collection"), "file", F.posexplode(inner).alias("unit_ord", "u"))
    return rows.select("collection", "file", F.col("u.id").alias("unit_id"), "unit_ord", F.col("u.segments").alias("segments"))


def explode_segments(units: DataFrame) -> DataFrame:
    """``(collection, unit_id, seg_ord, segment_id, text, tokens)``."""
    rows = units.select("collection", "unit_id", F.posexplode("segments").alias("seg_ord", "s"))
    return rows.select("collection", "unit_id", "seg_ord", F.col("s.id").alias("segment_id"), F.coalesce("s.pali", "s.text").alias("text"), F.col("s.tokens").alias("tokens"))


def read_segment_map(spark: SparkSession, path: str) -> DataFrame:
    """``(file, seg_ord, segment_id, text)`` of JSON objects from segment id to text; tags stripped, empty texts and ``{}`` dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    rows = raw.select("file", F.posexplode(F.map_entries("m")).alias("seg_ord", "e"))
    text = F.trim(F.regexp_replace("e.value", "<[^>]+>", ""))
    return rows.select("file", "seg_ord", F.col("e.key").alias("segment_id"), text.alias("text")).where("text not in ('', '{}')")


def running_text(segments: DataFrame, key: str = "file") -> DataFrame:
    """Texts of a key's segments as one, in order, without header segments (``:0.`` in the id)."""
    rows = segments.where(~F.col("segment_id").contains(":0."))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "text"))), lambda x: x["text"]), " ").alias("text"))


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)`` of plain-text volumes: byte-order mark and carriage returns dropped, white space collapsed."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    plain = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    return raw.select("file", F.trim(F.regexp_replace(F.regexp_replace(plain, "[ \t]+", " "), "\n{2,}", "\n")).alias("text"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Sandhi rules ``(a, b, c, d, weight)`` from a tab-separated file; malformed rows are skipped."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    rows = raw.select(F.col("chA").alias("a"), F.col("chB").alias("b"), F.coalesce("ch1", F.lit("")).alias("c"), F.coalesce("ch2", F.lit("")).alias("d"), F.col("weight").try_cast("int").alias("weight"))
    return rows.where("a is not null and b is not null and weight is not null")


def custom_lexicon(spark: SparkSession, text: str) -> DataFrame:
    """``(word, section, lemma, pos)`` of a YAML lexicon; later sections override earlier ones, malformed entries are skipped."""
    import yaml

    rows, data = {}, yaml.safe_load(text) or {}
    for section in data:
        for word, entry in (data[section] or {}).items() if isinstance(data[section], dict) else ():
            if isinstance(entry, dict) and isinstance(entry.get("lemma"), str):
                rows[str(word).lower()] = (str(word).lower(), str(section), entry["lemma"], str(entry.get("pos") or ""))
    return spark.createDataFrame(list(rows.values()), "word string, section string, lemma string, pos string")


def sqlite_pages(spark: SparkSession):
    """Register the ``lectio_pages`` data source: ``spark.read.format("lectio_pages").option("path", db).load()``."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.table = options["path"], options.get("table", "pages")

        def partitions(self):
            import sqlite3

            with sqlite3.connect(self.path) as c:
                return [InputPartition(v[0]) for v in c.execute(f'select distinct volume from "{self.table}" order by 1')]

        def read(self, partition):
            import sqlite3

            with sqlite3.connect(self.path) as c:
                for row in c.execute(f'select volume, page, content from "{self.table}" where volume = ? order by cast(page as integer)', (partition.value,)):
                    yield tuple(None if x is None else str(x) for x in row)

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "lectio_pages"

        def schema(self):
            return "volume string, page string, content string"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Pages)


def require(frame: DataFrame, what: str) -> DataFrame:
    """``frame``, or an error if it has no row: a missing dictionary must stop a run before it judges words by it."""
    if frame.isEmpty():
        raise ValueError(f"{what} is missing or empty")
    return frame
