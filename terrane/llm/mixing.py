"""Temperature mixing of sources to target weights.

Token shares p of the sources become weights p**a / sum(p**a). The exponent a in
[0, 1] is bisected: the flattest mixture whose entropy does not pass the target
and in which no source is repeated more often than the limit. Each bisection step
is one distributed aggregation over the table of sources, which never reaches the
driver.

The weights become token budgets. With no total given, the total is the least in
which every document occurs at least once. A source's budget is realised as
epochs; in each the source's documents are dealt into blocks by a hash of epoch
and doc_id, blocks and documents in blocks follow their hashes, and the last
epoch stops when the budget is met (the document that crosses it is the last). So
a budget is missed by less than one document, and only blocks, never a whole
source, are put in order in one task.

The unit is a word between blanks, as a JVM-side stand-in for tokens; a source in
a script without blanks counts far too little in it.

Defined results: null and empty texts, and those without words, cost nothing and
occur once in each epoch; null sources are one source; texts of any length are
counted whole, and a document is never cut; rows that share a doc_id are placed by
their texts too, and only rows equal in both share a place in the order, where
they follow each other; an empty table gives an empty result; columns of docs are
kept apart, in a struct, so that their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import stage, whole_text, words

NONE = "(none)"


@dataclass(frozen=True)
class Mixture:
    #: Target entropy as a share of that of equal weights.
    entropy: float = 0.97
    #: Most epochs of any source, relative to the least repeated one.
    repeats: float = 4.0
    block_tokens: int = 1 << 18
    seed: int = 1
    #: Total tokens; None: every document once at least.
    budget: int | None = None


def source_key() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(NONE))


def tie() -> Column:
    return F.xxhash64(whole_text().cast("string"))


def bisected(sources: DataFrame, mix: Mixture, parts: int = 16, rounds: int = 7) -> float:
    """The least exponent in [0, 1] that keeps to the target and the limit.

    Each round cuts the interval in `parts` and keeps the part where the
    condition changes; both entropy and repetition fall as the exponent rises.
    """
    base = sources.filter("tokens > 0").agg(
        F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("tokens").alias("a"), F.min("tokens").alias("b")
    ).first()
    if not base["n"]:
        return 1.0
    total, spread = float(base["t"]), float(base["a"]) / float(base["b"])
    p = F.col("tokens") / F.lit(total)

    def held(exponents: list[float]) -> list[bool]:
        sums = sources.filter("tokens > 0").agg(
            *(F.sum(F.pow(p, F.lit(a))).alias(f"s{i}") for i, a in enumerate(exponents)),
            *(F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}") for i, a in enumerate(exponents)),
            F.log(F.count("*")).alias("h"),
        ).first()
        from math import log

        out = []
        for i, a in enumerate(exponents):
            entropy = log(sums[f"s{i}"]) - a * sums[f"l{i}"] / sums[f"s{i}"]
            out.append(entropy <= mix.entropy * sums["h"] and spread ** (1 - a) <= mix.repeats)
        return out

    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / parts for i in range(1, parts)]
        good = held([low, *grid])
        if good[0]:
            return low
        first = next((i for i, ok in enumerate(good[1:]) if ok), None)
        low, high = (grid[-1], high) if first is None else (grid[first - 1] if first else low, grid[first])
    return high


def order_hash(mix: Mixture, epoch: Column) -> Column:
    """Of a row's doc_id and tie: rows of one doc_id are put apart by their texts."""
    return F.xxhash64(F.lit(mix.seed), epoch.cast("int"), F.col("doc_id"), F.col("tie"))


def block_of(hash_: Column) -> Column:
    return F.pmod(F.xxhash64(hash_), F.col("blocks")).cast("long")


def planned(docs: DataFrame, mix: Mixture) -> DataFrame:
    """One row for each source: weight, budget, whole epochs, and where the last one stops."""
    sizes = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            source_key().alias("source"),
            tie().alias("tie"),
            F.size(words(whole_text().cast("string"))).cast("long").alias("n_tokens"),
        ),
        "mix-sizes",
    )
    sources = stage(sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    a = bisected(sources, mix)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))).otherwise(F.lit(0.0))
    sums = sources.agg(
        F.sum(raw).alias("s"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / raw)).alias("m")
    ).first()
    scale = float(sums["s"] or 1.0)
    budget = float(mix.budget) if mix.budget is not None else float(sums["m"] or 0.0) * scale
    plan = (
        sources.withColumn("weight", raw / F.lit(scale))
        .withColumn("budget", F.round(F.col("weight") * F.lit(budget)).cast("long"))
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("cast(budget div tokens as int)")).otherwise(F.lit(1)))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)))
        .withColumn("blocks", F.greatest(F.ceil(F.col("tokens") / F.lit(mix.block_tokens)), F.lit(1)).cast("long"))
    )
    plan = stage(plan, "mix-plan")
    last = (
        sizes.join(plan.filter("rest > 0").select("source", "epochs", "blocks", "rest"), "source")
        .withColumn("h", order_hash(mix, F.col("epochs")))
        .withColumn("block", block_of(F.col("h")))
    )
    by_block = last.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("block"))
    cut = (
        by_block.withColumn("before", upto - F.col("n"))
        .filter("before < rest and before + n >= rest")
        .groupBy("source")
        .agg(F.min(F.struct("block", "before")).alias("c"))
        .select("source", F.col("c.block").alias("cut_block"), F.col("c.before").alias("before"))
    )
    edge = last.join(cut, "source").filter("block = cut_block")
    gone = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1))
    edge = (
        edge.withColumn("gone", F.col("before") + F.coalesce(gone, F.lit(0)))
        .filter("gone < rest")
        .groupBy("source")
        .agg(F.max("cut_block").alias("cut_block"), F.max("h").alias("cut_hash"))
    )
    return stage(plan.join(edge, "source", "left"), "mix-cuts")


def mixed(docs: DataFrame, mix: Mixture | None = None) -> DataFrame:
    """A row for each occurrence: doc (a struct of the columns of docs), and its place:
    source, weight, epoch, block and the hash that orders it.

    The plan has one row for each source; texts aren't shuffled where it is small
    enough to be broadcast, which adaptive execution decides by its size.
    """
    mix = mix or Mixture()
    plan = planned(docs, mix).select("source", "weight", "epochs", "blocks", "cut_block", "cut_hash")
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("doc"), source_key().alias("source"), F.col("doc_id").cast("long").alias("doc_id"), tie().alias("tie"))
    rows = rows.join(plan, "source")
    h = order_hash(mix, F.col("epochs"))
    once_more = F.coalesce(
        (block_of(h) < F.col("cut_block")) | ((block_of(h) == F.col("cut_block")) & (h <= F.col("cut_hash"))), F.lit(False)
    )
    rows = rows.withColumn("copies", F.col("epochs") + once_more.cast("int")).filter("copies > 0")
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0, copies - 1)")))
    rows = rows.withColumn("order", order_hash(mix, F.col("epoch"))).withColumn("block", block_of(F.col("order")))
    return rows.select("doc", "source", "weight", "epoch", "block", "order")


def placed(docs: DataFrame, mix: Mixture | None = None) -> DataFrame:
    """Each occurrence of each document and its place in its source's block permutation.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    rows = mixed(narrow, mix).withColumn("n_tokens", F.size(words(whole_text("doc.text").cast("string"))).cast("long"))
    slot = F.row_number().over(Window.partitionBy("source", "epoch", "block").orderBy("order", "doc_id", "n_tokens"))
    return rows.select("doc.doc_id", "source", "epoch", "block", "n_tokens", "weight", "order").select(
        "doc_id", "source", "epoch", "block", (slot - 1).cast("long").alias("slot"), "n_tokens", "weight"
    )
