"""Sinks: tables that are replaced as a whole, and rows as JSON lines.

A Parquet folder can't be changed in place. A new version is written beside the
old one under a name of its own, and a small pointer file, renamed into place,
says which version counts; readers always see a whole version, and a job that
dies leaves the old one. Nothing is gathered at the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T

_POINTER = "CURRENT"


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration())


def _version(spark: SparkSession, folder: str) -> str | None:
    p, fs = _at(spark, f"{folder}/{_POINTER}")
    if not fs.exists(p):
        return None
    return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "UTF-8").strip()


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The current version, or ``None`` before the first."""
    v = _version(spark, folder)
    return None if v is None else spark.read.parquet(f"{folder}/{v}")


def replace(df: DataFrame, folder: str) -> None:
    """Makes ``df`` the current version; the version before it is removed."""
    spark = df.sparkSession
    old, new = _version(spark, folder), f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{new}")
    draft, fs = _at(spark, f"{folder}/{_POINTER}-{new}")
    out = fs.create(draft)
    out.write(new.encode())
    out.close()
    target, _ = _at(spark, f"{folder}/{_POINTER}")
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri())
    flags = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    flags[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, target, flags)
    if old:
        p, _ = _at(spark, f"{folder}/{old}")
        fs.delete(p, True)


def upsert(new: DataFrame, folder: str, key: str = "id") -> None:
    """Rows of ``new`` replace stored rows of their key; of several with one key the greatest stays; an empty ``new`` changes nothing."""
    spark = new.sparkSession
    rest = [c for c in new.columns if c != key]
    one = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])
    old = read(spark, folder)
    if old is None:
        replace(one, folder)
    elif not one.isEmpty():
        replace(old.join(one.select(key), key, "left_anti").unionByName(one.select(*old.columns)), folder)


def vectors(objects: DataFrame, embed, key: str = "id") -> DataFrame:
    """``key, embedded_text, ktype, confidence, ts_sec, video_id, collection, embedding`` of objects, ready for ``upsert``."""
    o = objects.filter("content is not null and ktype is not null").select(
        key, F.concat("ktype", F.lit(": "), "content").alias("embedded_text"), "ktype", "confidence", "ts_sec", "video_id", T.collection_name(F.concat(F.lit("ko_"), "video_id")).alias("collection")
    )
    return embed(o, "embedded_text")


def chunk_ids(video: str, chunk: str) -> Column:
    return F.concat_ws("_", video, F.col(chunk).cast("string"))


def json_rows(df: DataFrame, key: str, name: str = "response") -> DataFrame:
    """``key`` and the whole row as JSON, null fields kept."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))
