"""Archives over HTTP, into a shared folder, and the cache that says which are there.

Each archive is asked for with what the cache knows of it, so that one that hasn't
changed isn't sent again. Executors fetch; the driver only sees the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import url_key, url_ordered
from terrane.operators.storage import settled

CACHE = "url_key string, url string, etag string, last_modified string, content_length long, crc32 long, status int"


def cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, empty if there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE)


def met(rows: DataFrame, others: DataFrame, how: str, *columns: str) -> DataFrame:
    """rows joined with columns of others by their URLs, since different URLs can share a key."""
    of = others.select(url_ordered(F.col("url")).alias("_url"), *columns)
    return rows.withColumn("_url", url_ordered(F.col("url"))).join(of, "_url", how).drop("_url")


def cache_put(known: DataFrame, rows: DataFrame) -> DataFrame:
    """known with rows written over the entries of the same URL."""
    return met(known, rows, "left_anti").unionByName(rows)


def cache_without(known: DataFrame, urls: DataFrame) -> DataFrame:
    return met(known, urls, "left_anti")


def stored(rows: DataFrame, path: str) -> DataFrame:
    """rows in place of the cache at path, which they may have been read from."""
    settled(rows, "dataset-cache").write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(CACHE).parquet(path)


def answered(url: str, etag: str | None, last_modified: str | None, head: bool, timeout: float):
    """(status, headers, body) of a conditional request; 304: as it was, 0: no answer."""
    import urllib.error
    import urllib.request

    headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", last_modified)) if v}
    asked = urllib.request.Request(url, headers=headers, method="HEAD" if head else "GET")
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as r:
            return r.status, r.headers, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers, b""
    except OSError:
        return 0, {}, b""


def fetched(urls: DataFrame, known: DataFrame, head: bool = False, parallel: int = 6, timeout: float = 60.0) -> DataFrame:
    """(the cache's columns, content) of each different URL; content is null where nothing new came.

    head: only asks whether there is something new. At most `parallel` requests
    run at a time; the rows are few, one for each archive.
    """
    asked = urls.select("url").distinct().withColumn("url_key", url_key(F.col("url")))
    asked = met(asked, known, "left", "etag", "last_modified").select("url_key", "url", "etag", "last_modified")

    def run(batches) -> Iterator:
        import zlib

        import pandas as pd

        for batch in batches:
            for key, url, etag, stamp in batch.itertuples(index=False):
                status, headers, body = answered(url, etag, stamp, head, timeout)
                got = status == 200 and not head
                yield pd.DataFrame([{
                    "url_key": key, "url": url, "etag": headers.get("ETag") or etag, "last_modified": headers.get("Last-Modified") or stamp,
                    "content_length": int(headers.get("Content-Length") or len(body)), "crc32": zlib.crc32(body) if got else None,
                    "status": status, "content": body if got else None,
                }])

    return asked.repartition(parallel, "url_key").mapInPandas(run, CACHE + ", content binary")


def to_update(urls: DataFrame, known: DataFrame, **how) -> DataFrame:
    """(url, status) of archives that the server says are new; those not in the cache always are."""
    found = fetched(urls, known, head=True, **how)
    new = met(found, known, "left_anti").select("url", "status")
    return new.unionByName(met(found, known, "left_semi").filter("status = 200").select("url", "status")).distinct()


def archives(new: DataFrame, folder: str) -> DataFrame:
    """What is to be written below folder/archives: new ones, and those of other URLs that lie in the same folders."""
    rows = new.select("url_key", "url", "content")
    try:
        there = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/archives")
    except AnalysisException:
        return rows
    beside = met(there.join(F.broadcast(rows.select("url_key").distinct()), "url_key", "left_semi"), rows, "left_anti")
    # What is read is written over, so it has to lie elsewhere first.
    return rows.unionByName(settled(beside, "archives-beside"))


def download(urls: DataFrame, folder: str, **how) -> DataFrame:
    """Fetches what is new into folder/archives (as ZIP entries, see registry.unzipped) and updates folder/cache.

    (url, status) of each archive comes back. An archive that failed leaves the cache as it was.
    """
    spark = urls.sparkSession
    known = cache(spark, f"{folder}/cache")
    found = settled(fetched(urls, known, **how), "downloads")
    new = found.filter("status = 200")
    archives(new, folder).write.mode("append").partitionBy("url_key").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/archives")
    stored(cache_put(known, new.drop("content")), f"{folder}/cache")
    return found.select("url", "status")
