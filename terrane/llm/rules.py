"""Quality rules whose thresholds follow the corpus.

Fixed rules first (too few words, too much repeated). Then each statistic gets
fences from a mergeable quantile sketch for each language and source: a histogram
of integers cut to their six leading bits, so a quantile is off by 1/32 of its
value at most, and sketches of parts, sources or languages merge by adding counts.
A fence lies WIDE spreads beyond the outer tenth, the spread being the distance
from there to the median. Where more than nine tenths of a group have the same
value, which most have of repeated lines, say, that spread is 0, and the least
spread that counts decides alone. A group with fewer than MIN_ROWS rows uses its
language's merged sketch, and a language with fewer the corpus's. Everything runs
as DataFrame expressions.

Defined results: a null text has no words and, like an empty one, fails the fixed
rules; null languages and sources are groups of their own; texts of any length are
counted whole; repeated rows count as often as they occur, and rows that tie with
a fence are kept; an empty table gives an empty result; columns besides doc_id,
text, lang and source are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import WORD, let, next_hashes, stage, whole_text, words

MIN_ROWS = 50
#: Spreads beyond the outer tenths that are still accepted.
WIDE = 3
#: Each statistic in thousandths, the least spread that counts, and whether low values fail too.
STATISTICS = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", 50, False),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 120, False),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 95, False),
    "word_length": ("1000 * word_chars div greatest(n_words, 1)", 100, True),
}


def repeated_words(hashes: Column, width: int = 8) -> Column:
    """Words that lie in a window of `width` words found more than once, first ones included."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            n = F.size(s)
            none = F.array(F.lit(None).cast("struct<h: bigint, i: int>"))
            trio = F.arrays_zip(
                s.alias("s"),
                F.concat(F.slice(s, 2, n - 1), none).alias("after"),
                F.concat(none, F.slice(s, 1, n - 1)).alias("before"),
            )
            twice = F.filter(trio, lambda z: (z["s"]["h"] == z["after"]["h"]) | (z["s"]["h"] == z["before"]["h"]))
            return F.sort_array(F.transform(twice, lambda z: z["s"]["i"]))

        return F.aggregate(
            let(placed, repeats),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
            lambda a, i: F.struct(
                (i + width).alias("end"), (a["total"] + i + width - F.greatest(a["end"], i)).alias("total")
            ),
            lambda a: a["total"],
        )

    return let(
        next_hashes(hashes, width),
        lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)),
    )


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        whole_text().cast("string").alias("text"),
    )
    text = text.withColumn("w", words(F.col("text"))).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    )
    return text.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.transform("w", lambda x: F.xxhash64(x))).cast("long").alias("n_repeat_words"),
    )


def sketch_bin(value: Column) -> Column:
    """A whole number of zero or more, cut to its six leading bits."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, statistic, bin, rows): the mergeable sketch of each group."""
    pairs = F.explode(
        F.array(*(F.struct(F.lit(k).alias("statistic"), F.expr(f"cast({e} as bigint)").alias("v")) for k, (e, _, _) in STATISTICS.items()))
    )
    return (
        stats.filter("not base_failed")
        .select("lang", "source", pairs.alias("p"))
        .select("lang", "source", "p.statistic", sketch_bin(F.col("p.v")).alias("bin"))
        .groupBy("lang", "source", "statistic", "bin")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and fences by keys, from sketches merged over all else."""
    merged = sketch.groupBy(*keys, "statistic", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "statistic")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("rows", F.sum("n").over(w))
    at = lambda tenths: F.min(F.when(10 * F.col("upto") >= tenths * F.col("rows"), F.col("bin")))
    tenths = ranked.groupBy(*keys, "statistic").agg(
        at(1).alias("t1"), at(5).alias("t5"), at(9).alias("t9"), F.max("rows").alias("rows")
    )
    least = F.lit(0)
    both = F.lit(False)
    for k, (_, spread, low) in STATISTICS.items():
        least = F.when(F.col("statistic") == k, F.lit(spread)).otherwise(least)
        both = F.when(F.col("statistic") == k, F.lit(low)).otherwise(both)
    return (
        tenths.withColumn("fence", F.struct(
            F.when(both, F.col("t1") - WIDE * F.greatest(F.col("t5") - F.col("t1"), least)).otherwise(F.lit(-1)).cast("long").alias("low"),
            (F.col("t9") + WIDE * F.greatest(F.col("t9") - F.col("t5"), least)).cast("long").alias("high"),
        ))
        .groupBy(*keys)
        .agg(F.max("rows").alias("rows"), *(F.max(F.when(F.col("statistic") == k, F.col("fence"))).alias(k) for k in STATISTICS))
    )


def ruled(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, with its counts, base_failed and kept."""
    stats = stage(
        counted(docs).withColumn(
            "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
        ),
        "rule-stats",
    )
    sketch = stage(sketches(stats), "rule-sketches")
    own, lang = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"])
    # The corpus's own fences are one row, and so constants of the plan.
    world = fences(sketch, []).first()

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))

    out = stats.join(
        named(own, "a"), F.col("lang").eqNullSafe(F.col("a_lang")) & F.col("source").eqNullSafe(F.col("a_source")), "left"
    ).join(named(lang, "b"), F.col("lang").eqNullSafe(F.col("b_lang")), "left")
    kept = ~F.col("base_failed")
    for k, (e, _, _) in STATISTICS.items():
        whole = world[k] if world and world[k] else {"low": None, "high": None}
        fence = (
            F.when(F.col("a_rows") >= MIN_ROWS, F.col(f"a_{k}"))
            .when(F.col("b_rows") >= MIN_ROWS, F.col(f"b_{k}"))
            .otherwise(F.struct(*(F.lit(whole[c]).cast("long").alias(c) for c in ("low", "high"))))
        )
        v = F.expr(f"cast({e} as bigint)")
        kept = kept & F.coalesce((v >= fence["low"]) & (v <= fence["high"]), F.lit(True))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )
