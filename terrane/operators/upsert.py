"""Upserts of registry tables, what changed, and routing by municipality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions.text import record_crc


def last_of(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def attrs_with_pos(attrs: DataFrame, pos: DataFrame, keys: list[str]) -> DataFrame:
    """Attributes and positions of the same keys; either alone still makes a row."""
    return attrs.join(pos, keys, "full")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """old with the rows of new written over it; a row whose record is the same is left as it was.

    changed says what happened: `new`, `updated` or `same`. Applying the same
    rows twice changes nothing the second time.
    """
    o = old.select(*keys, *(F.col(v).alias(f"_o_{v}") for v in values), F.lit(True).alias("_in_old"))
    n = new.select(*keys, *(F.col(v).alias(f"_n_{v}") for v in values), F.lit(True).alias("_in_new"))
    both = o.join(n, keys, "full")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"_o_{v}").eqNullSafe(F.col(f"_n_{v}"))
    write = F.col("_in_new").isNotNull() & (F.col("_in_old").isNull() | differs)
    return both.select(
        *keys,
        *(F.when(write, F.col(f"_n_{v}")).otherwise(F.col(f"_o_{v}")).alias(v) for v in values),
        F.when(F.col("_in_old").isNull(), "new").when(write, "updated").otherwise("same").alias("changed"),
    )


def positions_updated(main: DataFrame, pos: DataFrame, keys: list[str]) -> DataFrame:
    """Main rows with the latest positions; a position without a main row makes a stub."""
    p = pos.select(*keys, F.col("rep_lat").alias("_lat"), F.col("rep_lon").alias("_lon"))
    return main.join(p, keys, "full").select(
        *(c for c in main.columns if c not in ("rep_lat", "rep_lon")),
        F.coalesce("_lat", "rep_lat").alias("rep_lat"),
        F.coalesce("_lon", "rep_lon").alias("rep_lon"),
    )


def with_crc(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("crc32", record_crc(*map(F.col, columns)))


def changed_packages(catalog: DataFrame, seen: DataFrame, key: str = "url_key", stamp: str = "last_modified") -> DataFrame:
    """Catalog entries that are new or whose stamp differs from the one seen."""
    s = seen.select(key, F.col(stamp).alias("_seen"))
    return catalog.join(s, key, "left").filter(~F.col("_seen").eqNullSafe(F.col(stamp)) | F.col("_seen").isNull()).drop("_seen")


def lg_targets(codes: DataFrame, known: DataFrame) -> DataFrame:
    """Requested codes: known cities asked for themselves or by their prefecture (`NN....`)."""
    prefs = codes.filter(F.col("lg_code").endswith("....")).select(F.substring("lg_code", 1, 2).alias("p")).distinct()
    rest = codes.filter(~F.col("lg_code").endswith("....")).select("lg_code").distinct()
    by_pref = known.withColumn("p", F.substring("lg_code", 1, 2)).join(prefs, "p", "left_semi").drop("p")
    return by_pref.unionByName(known.join(rest, "lg_code", "left_semi")).distinct()


def lg_filter(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return rows.join(wanted.select("lg_code").distinct(), "lg_code", "left_semi")


def write_routed(rows: DataFrame, path: str) -> None:
    """One folder for each municipality, replaced as a whole where it is written.

    The folder's name is a column of its own, since a code read from it would be
    taken for a number and lose its zeros.
    """
    routed = rows.withColumn("municipality", F.col("lg_code"))
    routed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("municipality").parquet(path)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a table exists and has a row."""
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False
