"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint is the K least of the distinct hashes of a text's shingles of five
words (a shorter text is one shingle, one without words has none). Fingerprints
of parts merge to the fingerprint of the whole by taking the K least of their
union. They estimate resemblance, containment and the number of distinct
shingles. All of it is DataFrame expressions on the JVM.

Defined results: null texts are empty, and like those without words have empty
fingerprints; texts of any length are used whole; rows that share a doc_id are each
edited with the least text of the next document; repeated rows keep their rows; a
row without doc_id has no next document; ties don't matter, since a sketch has no
order; an empty table gives an empty result; columns besides doc_id and text are
never looked at. Two empty fingerprints resemble each other by 1, an empty
one and another by 0.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import let, next_hashes, whole_text, words

K = 128
SHINGLE = 5


def fingerprint(text: Column, k: int = K) -> Column:
    """Ascending array of at most k longs."""

    def of(w: Column) -> Column:
        hashes = F.when(
            F.size(w) >= SHINGLE, next_hashes(F.transform(w, lambda x: F.xxhash64(x)), SHINGLE)
        ).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    return let(words(text), of)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: of the k least hashes of the union, the share in both."""
    shared = F.size(F.array_intersect(merged(a, b, k), F.array_intersect(a, b)))
    return F.when(
        (F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))
    ).otherwise(shared / F.size(merged(a, b, k)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    least = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / least)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: J * |A or B| / |A|."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def written(a: Column) -> Column:
    """A fingerprint as a string: hexadecimal hashes of 16 digits each."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def longs(values: list[int]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below doc_id, by binary search."""
    known = longs(bounds)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0).cast("long")
    return F.aggregate(
        longs(steps),
        F.lit(0).cast("long"),
        lambda at, step: F.when(
            F.try_element_at(known, (at + step).cast("int")) < doc_id, at + step
        ).otherwise(at),
    )


def in_ranges(text: DataFrame) -> DataFrame:
    """(doc_id, text, part, salt, ghost): rows dealt into ranges of doc_id, as tasks get them.

    A doc_id that fills several ranges by itself is one range, dealt further by its
    texts (salt). The least text of a range's greatest doc_id is also put, as a
    ghost, before the next range (that of the last before the first), in each of
    its salts; so every task holds the next document of all its own. The driver
    learns one bound and one greatest doc_id for each range, as many as four times
    the partitions of a shuffle.
    """
    ids = text.select("doc_id")
    n = 4 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    # A quantile that comes up k times is the doc_id of as many shares of the rows.
    hot = {v: k for v, k in Counter(found).items() if k > 1}
    bounds = sorted({*found, *(v - 1 for v in hot)})
    salts = [hot.get(v, 1) for v in bounds] + [1]
    part = range_of(F.col("doc_id"), bounds)
    at = (F.col("part") + 1).cast("int")
    top = {r.part: r.top for r in ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(top)
    after = dict(zip(used, [*used[1:], *used[:1]], strict=True))
    ranges = range(len(bounds) + 1)
    dealt = text.withColumn("part", part)
    salted = F.pmod(F.xxhash64("text"), F.element_at(longs(salts), at))
    rows = dealt.select("doc_id", "text", "part", salted.alias("salt"), F.lit(0).alias("ghost"))
    is_top = F.col("doc_id") == F.element_at(longs([top.get(r, 0) for r in ranges]), at)
    ghosts = (
        dealt.filter(is_top)
        .groupBy("part", "doc_id")
        .agg(F.min("text").alias("text"))
        .withColumn("part", F.element_at(longs([after.get(r, 0) for r in ranges]), at))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(longs(salts), at) - 1)))
        .select("doc_id", "text", "part", "salt", F.lit(1).alias("ghost"))
    )
    return rows.unionByName(ghosts)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how near they are.

    Texts are exchanged once, into ranges of doc_id in which each row finds its
    next document before it. Where one doc_id has several texts, its neighbour is
    edited with the least of them. A row without doc_id has no next document and
    loses its last third.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("string").alias("text"))
    order = [F.desc("ghost"), F.col("doc_id"), F.desc("text")]
    rows = (
        in_ranges(text.filter("doc_id is not null"))
        .repartition("part", "salt")
        .sortWithinPartitions("part", "salt", *order)
        .withColumn("fp", fingerprint(F.col("text")))
    )
    near = Window.partitionBy("part", "salt").orderBy(*order)
    # The first row of a doc_id follows the least text of the next; its other rows take over what it found.
    first = (F.lag("ghost").over(near) == 1) | (F.lag("doc_id").over(near) != F.col("doc_id"))
    met = F.when(first, F.struct(F.lag("text").over(near).alias("text"), F.lag("fp").over(near).alias("fp")))
    known = (
        rows.withColumn("met", met)
        .withColumn("next", F.last("met", ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("ghost = 0")
        .select("doc_id", "text", "fp", F.col("next.text").alias("lead"), F.col("next.fp").alias("next_fp"))
    )
    alone = text.filter("doc_id is null").select(
        "doc_id",
        "text",
        fingerprint(F.col("text")).alias("fp"),
        F.lit(None).cast("string").alias("lead"),
        F.lit(None).cast("array<bigint>").alias("next_fp"),
    )
    third = F.floor(F.col("n_chars") / 3).cast("int")
    both = (
        known.unionByName(alone)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn(
            "edited",
            F.concat(
                F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - third),
                F.coalesce(F.col("lead").substr(F.lit(1), third), F.lit("")),
            ),
        )
        .select(
            "doc_id",
            "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            F.col("fp").alias("a"),
            fingerprint(F.col("edited")).alias("b"),
            F.coalesce("next_fp", F.array().cast("array<bigint>")).alias("c"),
        )
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("a")).alias("fingerprint"),
        written(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b")).alias("near_edited"),
        resemblance(F.col("a"), F.col("c")).alias("near_next"),
        distinct_shingles(F.col("a")).alias("n_distinct_shingles"),
        containment(F.col("a"), F.col("b")).alias("contained_in_edited"),
    )
