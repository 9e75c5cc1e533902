"""Registry files: their names, catalogs, archives and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of each kind of file.
KINDS = {
    "pref": "lg_code pref",
    "pref_pos": "lg_code rep_lat rep_lon rep_srid",
    "city": "lg_code pref county city ward",
    "city_pos": "lg_code rep_lat rep_lon rep_srid",
    "town": "lg_code machiaza_id pref county city ward oaza_cho chome koaza rsdt_addr_flg koaza_aka_code",
    "town_pos": "lg_code machiaza_id rep_lat rep_lon rep_srid rsdt_addr_flg",
    "rsdtdsp_blk": "lg_code machiaza_id blk_id blk_num",
    "rsdtdsp_blk_pos": "lg_code rep_lat rep_lon machiaza_id blk_id blk_num rep_srid",
    "rsdtdsp_rsdt": "lg_code machiaza_id blk_id blk_num rsdt_id rsdt_num rsdt2_id rsdt_num2 rsdt_addr_flg",
    "rsdtdsp_rsdt_pos": "lg_code rep_lat rep_lon machiaza_id blk_id rsdt_id rsdt2_id rep_srid rsdt_addr_flg",
    "parcel": "lg_code machiaza_id prc_id prc_num1 prc_num2 prc_num3 rsdt_addr_flg",
    "parcel_pos": "lg_code rep_lat rep_lon machiaza_id prc_id rep_srid",
}

#: Reference systems whose coordinates agree with WGS 84 within a nanodegree.
SRIDS = ("EPSG:4612", "EPSG:6668", "EPSG:4326")


def read_registry(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The known columns of a kind's CSV files, blanks as nulls, coordinates as doubles.

    A row whose reference system is missing or unknown has `rejected` set.
    """
    df = spark.read.option("header", True).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    df = df.toDF(*(c.strip().lstrip("﻿").lower() for c in df.columns))
    if "chome_number" in df.columns:
        df = df.withColumnRenamed("chome_number", "chome_num")
    out = df.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in KINDS[kind].split()))
    if "rep_srid" in out.columns:
        out = out.withColumns({c: F.col(c).try_cast("double") for c in ("rep_lat", "rep_lon")})
        out = out.withColumn("rejected", ~F.coalesce(F.upper("rep_srid").isin(*SRIDS), F.lit(False)))
    return out


def unzipped(files: DataFrame) -> DataFrame:
    """(archive, name, crc32, size, content) of each entry of ZIP archives (path, content)."""

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for archive, data in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield pd.DataFrame([{"archive": archive, "name": i.filename, "crc32": i.CRC, "size": i.file_size, "content": z.read(i)}])

    return files.select("path", "content").mapInPandas(run, "archive string, name string, crc32 long, size long, content binary")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of ZIP files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def filename_meta(name: Column) -> list[Column]:
    """kind and lg_code of a registry file's name; a prefecture's files cover `NN....`."""
    pattern = "^mt_(.+)_(all|pref[0-9]{2}|city[0-9]{6})"
    scope = F.regexp_extract(name, pattern, 2)
    kind = F.regexp_extract(name, pattern, 1)
    return [
        kind.alias("kind"),
        F.when(scope == "all", "000000")
        .when(scope.startswith("pref"), F.concat(F.substring(scope, 5, 2), F.lit("....")))
        .when(scope.startswith("city"), F.substring(scope, 5, 6))
        .alias("lg_code"),
    ]


def package_of_url(url: Column) -> list[Column]:
    """Dataset and lg_code of a package's URL, which names its scope twice."""
    pattern = r"/(mt_[a-z_]+?)/(all|pref|city)/mt_[a-z_]+?_(?:\2)?([0-9]*)[^/]*\.csv\.zip$"
    scope, code = F.regexp_extract(url, pattern, 2), F.regexp_extract(url, pattern, 3)
    return [
        F.nullif(F.regexp_replace(F.regexp_extract(url, pattern, 1), "^mt_", ""), F.lit("")).alias("dataset"),
        F.when(scope == "all", "000000")
        .when(scope == "pref", F.concat(F.substring(code, 1, 2), F.lit("....")))
        .when(scope == "city", code)
        .alias("lg_code"),
    ]


def package_of_id(package: Column, datasets: dict[str, str]) -> list[Column]:
    """The older identifiers: ba-o1-{lg_code}-g2-{number}."""
    parts = F.split(package, "[_-]")
    ok = (F.size(parts) == 5) & (F.get(parts, 0) == "ba") & (F.get(parts, 1) == "o1") & (F.get(parts, 3) == "g2")
    table = F.create_map(*(F.lit(x) for kv in datasets.items() for x in kv))
    return [F.when(ok, table[F.get(parts, 4)]).alias("dataset"), F.when(ok, F.get(parts, 2)).alias("lg_code")]


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(url, last_modified) of the CSV archives of a DCAT catalog file."""
    sets = spark.read.option("multiLine", True).json(path).select(F.explode("dataset").alias("d"))
    rows = sets.select("d.description", F.explode("d.distribution").alias("x")).select("description", F.col("x.accessURL").alias("url"))
    return rows.filter(F.col("url").contains(".csv.zip")).select(
        "url", F.regexp_extract("description", r"最終更新日:\s*(.+)", 1).alias("last_modified")
    )


def package_tree(packages: DataFrame, order: str) -> DataFrame:
    """lg_code with a map from dataset to URL; of equal ones the last stands."""
    last = packages.groupBy("lg_code", "dataset").agg(F.max_by("url", order).alias("url"))
    return last.groupBy("lg_code").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dataset", "url")))).alias("urls"))
