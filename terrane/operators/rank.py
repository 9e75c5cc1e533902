"""Scores of candidates, the best of each line, and the choice between residences and lots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.text import levenshtein_ratio

# Points by target, in the order of the levels 0 to 7.
POINTS = {
    "all": (-2, 1, 2, 3, 4, 5, 6, 4.5),
    "residential": (-2, 1, 2, 3, 4, 5, 6, -1),
    "parcel": (-2, 1, 2, 3, 4, -1, -1, 6),
}


def level_points(target: Column, level: Column) -> Column:
    """Points of a match level under a search target."""
    out = F.lit(None).cast("double")
    for name, points in POINTS.items():
        table = F.array(*(F.lit(float(p)) for p in points))
        out = F.when(target == name, F.element_at(table, (F.greatest(level, F.lit(0)) + 1).cast("int"))).otherwise(out)
    return out


def similarity(a: str = "input", b: str = "output") -> Column:
    return levenshtein_ratio(F.col(a), F.col(b))


def flag_agrees() -> Column:
    """The town's own flag agrees with the result's: 1 with a residence, 0 and 2 with a lot."""
    town, own = F.col("original_flg"), F.col("rsdt_addr_flg")
    return F.coalesce(((town == 1) & (own == 1)) | (town.isin(0, 2) & (own == 0)), F.lit(False))


def score() -> Column:
    """Points of a candidate: its two levels, less twice what they differ by, matched
    and unmatched characters, uncertain ones, similarity, and one if the flags agree.

    A street name of Kyoto counts as under a search for lots.
    """
    target = F.when(F.col("koaza_aka_code") == 2, F.lit("parcel")).otherwise(F.col("target"))
    level, coord = level_points(target, F.col("match_level")), level_points(target, F.col("coordinate_level"))
    return (
        level
        + coord
        - 2 * F.abs(level - coord)
        + F.col("matched_cnt")
        - F.length(F.coalesce("unmatched", F.lit("")))
        - F.col("ambiguous_cnt")
        + F.col("similarity")
        + flag_agrees().cast("int")
    ).cast("double")


def confident() -> Column:
    return (F.col("similarity") >= 0.5) | (F.col("matched_cnt") / F.length("input") >= 0.3) | (F.col("match_level") >= 2)


def top(cands: DataFrame, cand_id: str = "line_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The best candidate of each line; one that isn't confident only if none is."""
    rank = F.row_number().over(
        Window.partitionBy(cand_id).orderBy(F.desc("confident"), F.desc("score"), F.desc("matched_cnt"), *order)
    )
    return cands.withColumn("_r", rank).filter("_r = 1").drop("_r")


def chosen(cands: DataFrame, cand_id: str = "line_id", order: tuple[str, ...] = ("seq",), near: float = 2.0, by: str = "score") -> DataFrame:
    """The given candidate of each line, whole: the best residence (flag 1), the best lot (flag 0), or the best of all.

    A target of residences or lots decides between the two. Otherwise the lot is given
    where its score is higher, but not within `near` points of a residence whose town
    is marked residential. One that isn't confident counts only if none is.
    """
    line = Window.partitionBy(cand_id)
    sorted_ = line.orderBy(F.desc("confident"), F.desc(by), F.desc("matched_cnt"), *order)
    counts = F.col("confident") | ~F.max("confident").over(line)

    def best(flag: int) -> Column:
        info = F.struct("_r", F.col(by).alias("score"), "match_level", "original_flg")
        return F.min(F.when((F.col("rsdt_addr_flg") == flag) & F.col("_counts"), info)).over(line)

    r, p = F.col("_rsdt"), F.col("_prcl")
    marked = F.coalesce(r["original_flg"] == 1, F.lit(False)) & (r["match_level"] >= 3)
    residence = (
        F.when(F.col("target") == "residential", True)
        .when(F.col("target") == "parcel", False)
        .otherwise((r["score"] >= p["score"]) | ((p["score"] - r["score"] <= near) & marked))
    )
    given = F.when(r.isNull() | p.isNull(), F.coalesce(r["_r"], p["_r"], F.lit(1))).when(residence, r["_r"]).otherwise(p["_r"])
    return (
        cands.withColumn("_counts", counts)
        .withColumn("_r", F.row_number().over(sorted_))
        .withColumn("_rsdt", best(1))
        .withColumn("_prcl", best(0))
        .filter(F.col("_r") == given)
        .drop("_counts", "_r", "_rsdt", "_prcl")
    )
