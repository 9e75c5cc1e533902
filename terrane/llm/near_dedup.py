"""MinHash near-duplicates, with odd sketches between banding and exact checks.

1. Each text becomes a set of hashed word shingles; minima under many
   multiplicative permutations are its MinHash sample. The sample gives band
   keys, and is folded into an odd sketch: one parity bit for each cell that a
   sample value falls in. The population count of the XOR of two sketches
   estimates how many samples differ, most exactly where the sets are similar.
2. Equal sets are one class (they are linked at similarity 1); only the class's
   least document goes on.
3. Round one links each member of buckets with two of their leaders, the least
   and the one that shares most buckets, if the sketch allows and the whole
   shingle sets confirm it, and takes components.
4. Round two looks at the buckets that still span components. The members of the
   bucket's largest component needn't be compared with each other; all others are
   compared with all, in blocks of bounded size, by sketches. What the sketch
   can't rule out is confirmed on whole sets within the block, which unites
   components as it goes and gives out only the links that unite some. Pairs are
   never rows, no bucket is capped, and a pair that shares several buckets is
   compared in the first of them.

Chances of a pair just at the threshold: `miss` of sharing no bucket; it is ruled
out by the sketch only where that lies `far` standard deviations beyond what is
expected of it. Pairs that are more alike are missed far more seldom, and a
component is missed only if all links to it are. Sets are compared as sets of
64-bit hashes of shingles; no number of equal letters makes two words equal.

Defined results: null texts, empty ones and those without words have empty sets
and are linked with nothing; texts of any length are used whole; all rows that
have one doc_id are one document with several texts, linked if any two are;
repeated rows each keep a row; a null doc_id has no component and is always kept;
ties don't matter, since components don't depend on any order; an empty table
gives an empty result; columns besides doc_id and text are never looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import discard, mapped, stage
from terrane.llm.graph import components
from terrane.llm.hashing import U, mix, odd_constants, row_shingles

#: Bits of an odd sketch, in longs of 64.
SKETCH_BITS = 1024
LONGS = SKETCH_BITS // 64
#: Rows of a batch that are worked on at once.
ROWS = 512


@dataclass(frozen=True)
class Plan:
    shingle: int = 5
    #: Linked: 100 * intersection >= percent * union.
    percent: int = 80
    miss: float = 1e-6
    far: float = 4.0
    #: Members of a block whose sketches, and of a part whose sets are compared.
    block: int = 2048
    part: int = 256

    @property
    def rows(self) -> int:
        return 7 if self.percent >= 85 else 6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def banded(self) -> int:
        """Samples that the bands are made of; the sketch uses all."""
        return self.rows * self.bands

    #: MinHash samples folded into a sketch.
    samples: int = 400

    @property
    def most_odd(self) -> int:
        """Odd cells that a pair at the threshold exceeds by chance `far` deviations out.

        So many samples differ as a binomial says; each that does flips two cells.
        The deviation of the odd cells has a part from either.
        """
        share = 1 - self.percent / 100
        differ = self.samples * share

        def odd(d: float) -> float:
            return SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** (2 * d)) / 2

        of_samples = odd(differ + math.sqrt(differ * (1 - share))) - odd(differ)
        # Flips that meet in a cell take two odd cells away: about Poisson.
        of_cells = 2 * math.sqrt((2 * differ) ** 2 / (2 * SKETCH_BITS))
        return math.ceil(odd(differ) + self.far * math.hypot(of_samples, of_cells))


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's fingerprint, band keys, sketch."""

    def run(batches):
        import pyarrow as pa

        a = odd_constants(plan.samples, 11)
        cell = mix(np.arange(1, plan.samples + 1, dtype=U))
        weight = odd_constants(plan.rows, 23)
        tag = mix(np.arange(101, 101 + plan.bands, dtype=U))

        def signed(batch):
            n, f1, f2, minima = [], [], [], []
            for s in row_shingles(batch.column(1), plan.shingle):
                n.append(len(s))
                f1.append(s.sum(dtype=U))
                f2.append(np.bitwise_xor.reduce(mix(s ^ U(0x5851F42D4C957F2D))) if len(s) else U(0))
                m = np.full(plan.samples, U(2**64 - 1))
                for i in range(0, len(s), 256):
                    np.minimum(m, (s[i : i + 256, None] * a).min(axis=0), out=m)
                minima.append(m)
            rows = len(n)
            m = np.array(minima, U).reshape(rows, plan.samples)
            keys = mix((m[:, : plan.banded].reshape(rows, plan.bands, plan.rows) * weight).sum(axis=2, dtype=U) + tag)
            at = (mix(m ^ cell) >> U(64 - int(math.log2(SKETCH_BITS)))).astype(np.int64)
            at += np.arange(rows)[:, None] * SKETCH_BITS
            odd = (np.bincount(at.ravel(), minlength=rows * SKETCH_BITS) & 1).astype(np.uint8)
            sketch = np.packbits(odd).view(np.int64).reshape(rows, LONGS)
            some = np.array(n, np.int64) > 0
            ends = np.concatenate(([0], np.cumsum(some * plan.bands))).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array(n, np.int64)),
                    pa.array(np.array(f1, U).view(np.int64)),
                    pa.array(np.array(f2, U).view(np.int64)),
                    pa.ListArray.from_arrays(ends, keys[some].ravel().view(np.int64)),
                    *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(LONGS)),
                ],
                names=["doc_id", "n_shingles", "f1", "f2", "bands", *(f"s{i}" for i in range(LONGS))],
            )

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                yield signed(batch.slice(first, ROWS))

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
        "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, "
        + ", ".join(f"s{i} long" for i in range(LONGS)),
    )


def shingle_sets(docs: DataFrame, plan: Plan) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                sets = list(row_shingles(batch.column(1), plan.shingle))
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(ends, flat.view(np.int64))], names=["node", "shingles"]
                )

    return mapped(docs, run, "node long, shingles array<long>")


def odd_cells(x, y) -> Column:
    """Population count of the XOR of two sketches; x and y map names to columns."""
    return sum((F.bit_count(x(f"s{i}").bitwiseXOR(y(f"s{i}"))) for i in range(1, LONGS)), F.bit_count(x("s0").bitwiseXOR(y("s0"))))


def near_lengths(x: Column, y: Column, plan: Plan) -> Column:
    return 100 * F.least(x, y) >= plan.percent * F.greatest(x, y)


def confirmed(pairs: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Those pairs (a, b) that are linked by their whole shingle sets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    sets = stage(shingle_sets(texts.join(wanted, "node", "left_semi").select("node", "text"), plan), "near-sets")
    one = sets.dropDuplicates(["node", "shingles"])
    both = (
        pairs.select("a", "b")
        .join(one.toDF("a", "sa"), "a")
        .join(one.toDF("b", "sb"), "b")
        .withColumn("common", F.size(F.array_intersect("sa", "sb")))
    )
    near = 100 * F.col("common") >= plan.percent * (F.size("sa") + F.size("sb") - F.col("common"))
    links = stage(both.filter(near).select("a", "b").distinct(), "near-confirmed")
    discard(sets)
    return links


def blocks_of(batches, key: int):
    """Arrow tables of the rows that agree in the first `key` columns, from batches sorted by them."""
    import pyarrow as pa

    held: list = []
    last = None
    for whole in batches:
        if not whole.num_rows:
            continue
        keys = np.column_stack([whole.column(k).to_numpy(zero_copy_only=False) for k in range(key)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if last is not None and (keys[a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(whole.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def lists(column) -> list[np.ndarray]:
    """The values of a list column, one array for each row."""
    column = column.combine_chunks()
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def to_confirm(plan: Plan):
    """Over rows (bucket, i, j, own, rep, c, n_shingles, bands, sketch...) sorted by block:
    (bucket, i, j, p, q, at, rep, c, partners), one row for each member of a part that has to be confirmed.

    A part is where `part` rows of block i from the p-th on meet those of block j from the q-th on; partners
    are places, in block j, of what sketches allow to be linked with the row.
    """

    def run(batches):
        import pyarrow as pa

        names = ["bucket", "i", "j", "p", "q", "at", "rep", "c", "partners"]
        for t in blocks_of(batches, 3):
            bucket, i, j = (t.column(k)[0].as_py() for k in range(3))
            own, rep, c, n = (t.column(k).to_numpy() for k in range(3, 7))
            bands = np.array(lists(t.column(7)))
            sketch = np.column_stack([t.column(8 + k).to_numpy() for k in range(LONGS)]).view(U)
            one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for p in range(0, len(one), plan.part):
                left = one[p : p + plan.part]
                for q in range(p if i == j else 0, len(two), plan.part):
                    right = two[q : q + plan.part]
                    ok = c[left][:, None] != c[right]
                    ok &= 100 * np.minimum(n[left][:, None], n[right]) >= plan.percent * np.maximum(n[left][:, None], n[right])
                    if i == j and p == q:
                        ok &= left[:, None] < right
                    x, y = np.nonzero(ok)
                    for k in range(0, len(x), 1 << 14):
                        a, b = left[x[k : k + (1 << 14)]], right[y[k : k + (1 << 14)]]
                        near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= plan.most_odd
                        # A pair is compared in the first bucket that it shares.
                        here, there = np.flatnonzero(near), np.flatnonzero(~near)
                        equal = bands[a[here]] == bands[b[here]]
                        mine = bands[a[here], equal.argmax(axis=1)] == bucket
                        ok[x[k + there], y[k + there]] = False
                        ok[x[k + here[~mine]], y[k + here[~mine]]] = False
                    if not ok.any():
                        continue
                    use = np.flatnonzero(ok.any(axis=1))
                    met = np.flatnonzero(ok.any(axis=0))
                    rows = [(int(k), left[k], np.flatnonzero(ok[k])) for k in use.tolist()]
                    # Rows of the other side come after all of this one.
                    rows += [(plan.part + int(k), right[k], np.zeros(0, np.int64)) for k in met.tolist()]
                    m = len(rows)
                    at = np.array([r[1] for r in rows])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(np.full(m, v, np.int64)) for v in (bucket, i, j, p, q)),
                            pa.array([r[0] for r in rows], pa.int64()),
                            pa.array(rep[at]),
                            pa.array(c[at]),
                            pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                        ],
                        names=names,
                    )

    return run


def links_of_parts(plan: Plan):
    """Over rows (bucket, i, j, p, q, at, rep, c, partners, shingles) sorted by part and place:
    links (a, b) confirmed on whole sets, only such as unite components."""

    def run(batches):
        import pyarrow as pa

        for t in blocks_of(batches, 5):
            at = t.column(5).to_numpy()
            rep, c = t.column(6).to_pylist(), t.column(7).to_pylist()
            partners = lists(t.column(8))
            sets = [x.view(U) for x in lists(t.column(9))]  # sorted as unsigned
            # A document with several texts has a row for each of its sets.
            rows: dict[int, list[int]] = {}
            for k, place in enumerate(at.tolist()):
                rows.setdefault(place, []).append(k)
            up = {x: x for x in c}

            def find(x, up=up):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            links = []
            for k in range(len(at)):
                for place in partners[k].tolist():
                    for m in rows.get(plan.part + place, ()):
                        one, two = find(c[k]), find(c[m])
                        if one == two:
                            break
                        x, y = sets[k], sets[m]
                        if len(x) > len(y):
                            x, y = y, x
                        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                        if 100 * common >= plan.percent * (len(x) + len(y) - common):
                            up[max(one, two)] = min(one, two)
                            links.append((rep[k], rep[m]))
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links_across(buckets: DataFrame, found: DataFrame, side: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between the components found that share a bucket."""
    member = stage(
        buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
            "bucket", "rep", F.coalesce("component", "rep").alias("c")
        ),
        "near-members",
    )
    sizes = member.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    split = (
        sizes.groupBy("bucket")
        .agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("m"))
        .filter("m > top.n")
        .select(
            "bucket",
            F.col("top.c").alias("bulk"),
            F.ceil((F.col("m") - F.col("top.n")) / plan.block).cast("int").alias("few"),
            F.ceil(F.col("top.n") / plan.block).cast("int").alias("many"),
        )
    )
    dealt = (
        member.join(split, "bucket")
        .withColumn("rest", F.col("c") != F.col("bulk"))
        .withColumn(
            "own",
            F.when(F.col("rest"), F.pmod(F.xxhash64("rep"), "few")).otherwise(F.col("few") + F.pmod(F.xxhash64("rep"), "many")),
        )
        .join(side, "rep")
        # Rows outside of the largest component meet all blocks, its own rows only those outside.
        .withColumn("other", F.explode(F.expr("sequence(0, if(rest, few + many, few) - 1)")))
        .select(
            "bucket",
            F.least("own", "other").cast("long").alias("i"),
            F.greatest("own", "other").cast("long").alias("j"),
            F.col("own").cast("long").alias("own"),
            *("rep", "c", "n_shingles", "bands"),
            *(f"s{i}" for i in range(LONGS)),
        )
    )
    met = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "own", "rep")
    key = ["bucket", "i", "j", "p", "q"]
    parts = stage(
        mapped(met, to_confirm(plan), ", ".join(f"{k} long" for k in (*key, "at", "rep", "c")) + ", partners array<long>"),
        "near-parts",
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    wanted = texts.join(parts.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    sets = stage(shingle_sets(wanted.select("node", "text"), plan), "near-sets")
    own = sets.dropDuplicates(["node", "shingles"]).withColumnRenamed("node", "rep")
    together = parts.join(own, "rep").select(*key, "at", "rep", "c", "partners", "shingles")
    together = together.repartition(*key).sortWithinPartitions(*key, "at")
    links = stage(mapped(together, links_of_parts(plan), "a long, b long"), "near-more")
    discard(member, parts, sets)
    return links


def near_duplicates(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    plan = plan or Plan()
    sig = stage(signatures(docs, plan), "near-signatures")
    cells = [f"s{i}" for i in range(LONGS)]
    key = ["n_shingles", "f1", "f2"]
    named = sig.filter("n_shingles > 0 and doc_id is not null")
    reps = stage(
        named.groupBy(*key).agg(
            F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in cells)
        ),
        "near-classes",
    )
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    leaders = rows.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("m")).filter("m > 1").drop("m")
    buckets = stage(rows.join(leaders, "bucket"), "near-buckets")
    side = reps.select("rep", "n_shingles", "bands", *cells)

    def with_sides(pairs: DataFrame) -> DataFrame:
        out = pairs
        for c in ("a", "b"):
            out = out.join(side.select(F.col("rep").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n_shingles", *cells))), c)
        return out.withColumn("odd", odd_cells(lambda x: F.col(f"a_{x}"), lambda x: F.col(f"b_{x}"))).filter(
            near_lengths(F.col("a_n_shingles"), F.col("b_n_shingles"), plan) & (F.col("odd") <= plan.most_odd)
        )

    shared = buckets.filter("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("n"))
    hubs = F.array_distinct(F.array(F.max_by("leader", F.struct("n", F.expr("-leader"))), F.min("leader")))
    starred = shared.groupBy("rep").agg(hubs.alias("hubs")).select(F.explode("hubs").alias("a"), F.col("rep").alias("b"))
    first = stage(with_sides(starred).select("a", "b"), "near-first")
    sure = confirmed(first, docs, plan)
    linked = stage(sure.union(same_document(named, reps, key)), "near-links")
    discard(first, sure)
    found = stage(components(linked, "near-stars"), "near-found")
    more = links_across(buckets, found, side, docs, plan)
    if not more.isEmpty():
        before, found = found, stage(components(linked.union(more), "near-stars"), "near-found")
        discard(before)
    discard(buckets, linked, more)
    classes = (
        reps.select(*key, "rep")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*key, F.coalesce("component", "rep").alias("class_component"))
    )
    out = sig.select("doc_id", *key).join(classes, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def same_document(named: DataFrame, reps: DataFrame, key: list[str]) -> DataFrame:
    """Links between the classes that hold texts of one doc_id."""
    several = (
        named.groupBy("doc_id")
        .agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b"))
        .filter("a <> b")
        .select(F.col("doc_id").alias("a"))
    )
    classes = named.select(F.col("doc_id").alias("a"), *key).join(several, "a", "left_semi").distinct()
    return classes.join(reps.select(*key, F.col("rep").alias("b")), key).select("a", "b").filter("a <> b").distinct()
