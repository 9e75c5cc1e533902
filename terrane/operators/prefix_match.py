"""The dictionary match: which keys start a text, and what is left of it.

A candidate's text is cut at the lengths that keys of the dictionary have, and
the cuts are joined with the keys by equality, so the work grows with the number
of texts and not with the size of the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.constants import FUZZY

#: Keys of a dictionary up to which it is broadcast; larger ones are joined by shuffle.
BROADCAST_KEYS = 500_000


def sized(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """df with a hint to broadcast, if it has no more than `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def key_lengths(dictionary: DataFrame, key: str = "key") -> list[int]:
    """The lengths of keys, at most as many as the longest key has characters."""
    return sorted(r[0] for r in dictionary.select(F.length(key)).distinct().collect() if r[0])


def with_leaf(dictionary: DataFrame, key: str = "key") -> DataFrame:
    """is_leaf: no longer key starts with this one."""
    keys = dictionary.select(F.col(key).alias("k")).distinct()
    lengths = key_lengths(dictionary, key)
    inner = (
        keys.select("k", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
        .filter(F.col("n") < F.length("k"))
        .select(F.col("k").substr(F.lit(1), F.col("n")).alias("k"))
        .distinct()
        .withColumn("inner", F.lit(True))
    )
    return (
        dictionary.join(inner.withColumnRenamed("k", key), key, "left")
        .withColumn("is_leaf", F.col("inner").isNull())
        .drop("inner")
    )


def missing_words(dictionary: DataFrame, words: list[str], key: str = "key") -> DataFrame:
    """The dictionary and, for each word inside a key, the key without it; amb counts what was left out."""
    cut = F.array_distinct(
        F.array(
            F.struct(F.col(key).alias("k"), F.lit(0).alias("amb")),
            *(
                F.when(
                    F.instr(key, w) > 1, F.struct(F.replace(key, F.lit(w), F.lit("")).alias("k"), F.lit(len(w)).alias("amb"))
                ).otherwise(F.struct(F.col(key).alias("k"), F.lit(0).alias("amb")))
                for w in words
            ),
        )
    )
    return dictionary.withColumn("_v", F.explode(cut)).withColumn(key, F.col("_v.k")).withColumn("amb", F.col("_v.amb")).drop("_v")


def prefix_match(
    cands: DataFrame, dictionary: DataFrame, text: str, key: str = "key", mode: str = "all", cand_id: str = "line_id",
    lengths: list[int] | None = None, small: bool | None = None,
) -> DataFrame:
    """cands joined with each key that starts their text; adds depth and unmatched.

    mode: `all` keys, only the `longest`, or only a `leaf` (no longer key starts
    with it) and keys that are the whole text. lengths and small: the lengths of keys
    and whether the dictionary is to be broadcast, where these are known already.
    """
    lengths = key_lengths(dictionary, key) if lengths is None else lengths
    cuts = F.filter(F.array(*map(F.lit, lengths or [1])), lambda n: n <= F.length(text))
    keyed = with_leaf(dictionary, key) if mode == "leaf" else dictionary
    book = keyed.withColumnRenamed(key, "_cut")
    book = sized(book) if small is None else F.broadcast(book) if small else book
    hits = (
        cands.withColumn("depth", F.explode(cuts))
        .withColumn("_cut", F.col(text).substr(F.lit(1), F.col("depth")))
        .join(book, "_cut")
        .withColumnRenamed("_cut", key)
        .withColumn("unmatched", F.col(text).substr(F.col("depth") + 1, F.length(text)))
    )
    if mode == "leaf":
        return hits.filter(F.col("is_leaf") | (F.col("depth") == F.length(text)))
    if mode == "longest":
        most = F.max("depth").over(Window.partitionBy(cand_id))
        return hits.withColumn("_most", most).filter("depth = _most").drop("_most")
    return hits


def fuzzy_match(cands: DataFrame, dictionary: DataFrame, text: str, key: str = "key", on: tuple[str, ...] = ()) -> DataFrame:
    """Texts with wild cards: any key whose characters agree where the text has none.

    Texts and keys meet by length and by the text's first plain character, so
    that only keys that can agree are compared, and by the columns `on` of both.
    """
    lengths = key_lengths(dictionary, key)
    cut = (
        cands.filter(F.col(text).contains(FUZZY))
        .withColumn("depth", F.explode(F.filter(F.array(*map(F.lit, lengths or [1])), lambda n: n <= F.length(text))))
        .withColumn("_cut", F.col(text).substr(F.lit(1), F.col("depth")))
    )
    place = F.least(F.length(F.regexp_extract("_cut", r"^(\?*)", 1)) + 1, F.col("depth"))
    cut = cut.withColumn("_at", place).withColumn("_c", F.expr("substr(_cut, _at, 1)"))
    keys = (
        dictionary.withColumn("depth", F.length(key))
        .withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("depth"))))
        .withColumn("_c", F.explode(F.array(F.expr(f"substr({key}, _at, 1)"), F.lit(FUZZY))))
    )
    pattern = F.translate(F.regexp_replace("_cut", r"([%_\\])", r"\\$1"), FUZZY, "_")
    return (
        cut.withColumn("_pattern", pattern)
        .join(sized(keys), [*on, "depth", "_at", "_c"])
        .filter(F.expr(f"{key} like _pattern"))
        .withColumn("amb", F.length("_cut") - F.length(F.translate("_cut", FUZZY, "")))
        .withColumn("unmatched", F.col(text).substr(F.col("depth") + 1, F.length(text)))
        .drop("_cut", "_at", "_c", "_pattern")
    )


def best_per_info(hits: DataFrame, cand_id: str, info_id: str, score: Column) -> DataFrame:
    """For each candidate and dictionary row the hit with the best score, the shallowest on a tie."""
    rank = F.row_number().over(Window.partitionBy(cand_id, info_id).orderBy(score.desc(), F.col("depth")))
    return hits.withColumn("_r", rank).filter("_r = 1").drop("_r")


def digit_boundary(hits: DataFrame, key: str = "key") -> DataFrame:
    """Drops hits that cut a number in two."""
    return hits.filter(~(F.col(key).rlike("[0-9]$") & F.col("unmatched").rlike("^[0-9]")))


def keep_original(cands: DataFrame, hits: DataFrame, cand_id: str, ambiguous: Column | None = None) -> DataFrame:
    """Hits, and each candidate that had none or an ambiguous one, unchanged."""
    sure = hits if ambiguous is None else hits.filter(~ambiguous)
    unsure = hits.filter(ambiguous).select(cand_id).distinct() if ambiguous is not None else None
    settled = sure.select(cand_id).distinct()
    if unsure is not None:
        settled = settled.join(unsure, cand_id, "left_anti")
    kept = cands.join(settled, cand_id, "left_anti")
    return hits.unionByName(kept, allowMissingColumns=True)


def first_wins(cands: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A set of candidates: of equal ones the first in order stays."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return cands.withColumn("_r", rank).filter("_r = 1").drop("_r")
