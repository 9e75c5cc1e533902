"""Quality classifier: a sparse ensemble of rules.

Statistics of each whole text are counted in one pass. Boosted shallow trees are
grown on labelled rows; every path from a root to a node is a rule, a conjunction
of conditions on statistics. A lasso logistic regression over the rules keeps a
few with weights, and these are compiled to one Spark column expression, which
scores every document on the JVM.

Training uses at most about SAMPLE labelled rows, those of least hashes of doc_id;
that bound is the operator's parameter and the only thing that is bounded. Only
the texts of these rows are looked at for the fit, and they reach the driver as
statistics; then all texts are scored in one pass.

Defined results: a null or empty text has statistics of zero and is scored like
any other row; texts of any length are counted whole; a doc_id that has several
labels or several labelled texts counts once, with the least; labels that are
neither 0 nor 1, or have no doc_id, count for nothing; repeated rows are scored
each for itself; without labels every score is 0.5, with labels of one kind only
their smoothed share; an empty table gives an empty result. Columns whose names
are those of statistics aren't touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import mapped, unused
from terrane.llm.hashing import U, mix, odd_constants, text_buffers, word_hashes

SAMPLE = 20_000
#: Rows whose texts are looked at together.
ROWS = 1024
#: Least score of an accepted document.
ACCEPTED = 0.7
STATS = (
    "words", "word_bytes", "upper", "digit", "symbol", "exclaim", "stop", "wide", "pipe",
    "lines", "line_words", "distinct", "top", "pairs", "fives", "dup_lines",
)
_CLASS = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "symbol": b"#*$%&<>{}[]\\~^=_@",
    "exclaim": b"!?",
    "stop": b".,;:",
    "wide": range(128, 192),  # bytes that continue a character
    "pipe": b"|",
}


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of its commonest."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(v)))
    most = np.zeros(rows)
    np.maximum.at(most, r[at], runs)
    return np.bincount(r[at], minlength=rows).astype(float), most


def prefix_of(columns: list[str]) -> str:
    return unused(columns, "stat_")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and a double for each of STATS, named with prefix_of(keep)."""
    prefix = prefix_of(list(keep))

    def run(batches):
        import pyarrow as pa

        weights = odd_constants(5, 5)
        classes = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            offsets, data = text_buffers(batch.column(batch.num_columns - 1))
            rows = batch.num_rows
            out = {k: np.zeros(rows) for k in STATS}
            for first, hashes, bounds in word_hashes(offsets, data, lower=False):
                m = len(bounds) - 1
                a, cuts = int(offsets[first]), offsets[first : first + m + 1] - offsets[first]
                raw = data[a : a + int(cuts[-1])]
                part = slice(first, first + m)
                size = np.maximum(np.diff(cuts), 1)
                for k, is_in in classes.items():
                    total = np.concatenate(([0], np.cumsum(is_in[raw], dtype=np.int64)))
                    out[k][part] = (total[cuts[1:]] - total[cuts[:-1]]) / size
                n = np.diff(bounds).astype(float)
                out["words"][part] = n
                some = np.maximum(n, 1)
                blank = np.concatenate(([0], np.cumsum((raw == 32) | ((raw >= 9) & (raw <= 13)), dtype=np.int64)))
                out["word_bytes"][part] = (np.diff(cuts) - (blank[cuts[1:]] - blank[cuts[:-1]])) / some
                row = np.repeat(np.arange(m), np.diff(bounds))
                d, top = _distinct(hashes, row, m)
                out["distinct"][part], out["top"][part] = d / some, top / some
                for k, name in ((2, "pairs"), (5, "fives")):
                    if len(hashes) >= k:
                        joined = np.zeros(len(hashes) - k + 1, U)
                        for i in range(k):
                            joined += hashes[i : i + len(joined)] * weights[i]
                        one = row[: len(joined)] == row[k - 1 :]
                        d, _ = _distinct(mix(joined[one]), row[: len(joined)][one], m)
                        out[name][part] = d / np.maximum(n - k + 1, 1)
                # Lines are hashed as words are, cut at line ends only.
                ends = np.flatnonzero(raw == 10)
                out["lines"][part] = lines = np.diff(np.searchsorted(ends, cuts)) + 1.0
                out["line_words"][part] = n / lines
                text = raw.tobytes()
                for i in range(m):
                    if lines[i] > 1:
                        own = [x for x in text[cuts[i] : cuts[i + 1]].split(b"\n") if x]
                        out["dup_lines"][first + i] = 1 - len(set(own)) / max(1, len(own))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(out[k]) for k in STATS)], names=[*batch.schema.names[:-1], *(prefix + k for k in STATS)]
            )

    kinds = [f"`{k.replace('`', '``')}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    columns = [F.col(f"`{k.replace('`', '``')}`") for k in keep]
    return mapped(docs.select(*columns, F.col("text").cast("string").alias(prefix + "text")), run, ", ".join([*kinds, *(f"{prefix}{k} double" for k in STATS)])
    )


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, whether above, cut) hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, cut in self.conditions:
            out &= (x[:, f] > cut) == above
        return out

    def column(self, prefix: str) -> Column:
        out = F.lit(True)
        for f, above, cut in self.conditions:
            c = F.col(prefix + STATS[f])
            out = out & ((c > cut) if above else (c <= cut))
        return out


def grown_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2) -> list[Rule]:
    """Every path of boosted trees on binned statistics (logistic loss)."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 48))) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    share = (y.mean() * len(y) + 1) / (len(y) + 2)
    raw = np.full(len(y), np.log(share / (1 - share)))
    rules: dict[tuple, Rule] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        parts = [(np.arange(len(y)), ())]
        for level in range(depth):
            below = []
            for rows, path in parts:
                best = (1e-3, None)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, f]
                    gs = np.cumsum(np.bincount(b, g[rows], len(c) + 1))
                    hs = np.cumsum(np.bincount(b, h[rows], len(c) + 1))
                    left, right = gs[:-1] ** 2 / (hs[:-1] + 1), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
                    gain = left + right - gs[-1] ** 2 / (hs[-1] + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k))
                if best[1] is None:
                    raw[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                f, k = best[1]
                for above in (False, True):
                    own = rows[(binned[rows, f] > k) == above]
                    now = (*path, (f, above, float(cuts[f][k])))
                    rules.setdefault(tuple(sorted(now)), Rule(now))
                    if level == depth - 1:
                        raw[own] += rate * g[own].sum() / (h[own].sum() + 1)
                    else:
                        below.append((own, now))
            parts = below
    return list(rules.values())


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """L1 logistic regression by accelerated proximal gradient steps."""
    step = 4.0 / max(np.linalg.eigvalsh(z.T @ z / len(y)).max() + 1, 1e-9)
    share = (y.sum() + 1) / (len(y) + 2)
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log(share / (1 - share)))
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(z @ v + c, -40, 40))) - y
        w2 = v - step * (z.T @ r) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, prefix: str) -> Column:
        """The model as a column over statistics, 0 to 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += rule.of(x) * weight
        return 1 / (1 + np.exp(-total))


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(share / (1 - share))), ())
    rules = grown_rules(x, y)
    z = np.stack([r.of(x) for r in rules], axis=1).astype(float)
    support = z.mean(axis=0)
    scale = np.sqrt(np.maximum(support * (1 - support), 1e-4))
    b, w = lasso((z - support) / scale, y, penalty)
    kept = [(r, float(v)) for r, v in zip(rules, w / scale, strict=True) if abs(v) > 1e-6]
    return Ensemble(float(b - (w / scale * support).sum()), tuple(kept))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sampled(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, y) of about `sample` labels that aren't held out, or of all if they are fewer."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )
    n = known.count()
    if n <= sample:
        return known
    # A share of all hashes, a little less than asked for, so that chance rarely gives more.
    share = (sample - 3 * sample**0.5) / n
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """The ensemble learned from texts whose labels are sampled.

    The sampled labels are broadcast: their number is bounded by `sample`.
    """
    known = sampled(labels, sample)
    ids = F.broadcast(known.select("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    names = [prefix_of(["doc_id"]) + k for k in STATS]
    rows = (
        statistics(texts)
        .groupBy("doc_id")
        .agg(F.min(F.struct(*names)).alias("x"))
        .join(known, "doc_id")
        .select("doc_id", "y", "x.*")
        .toPandas()
        .sort_values("doc_id")
    )
    return fitted(rows[names].to_numpy(float), rows["y"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    model = trained(docs, labels, sample)
    rows = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", held_out().alias("held_out"), model.score(prefix_of(["doc_id"])).alias("score")).withColumn(
        "predicted", (F.col("score") >= ACCEPTED).cast("int")
    )


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with their columns, that the classifier accepts; texts are never shuffled.

    Without labels there is nothing to accept rows by, and all are kept.
    """
    model = trained(docs, labels, sample)
    if not model.rules:
        return docs
    rows = statistics(docs, tuple(docs.columns)).filter(model.score(prefix_of(docs.columns)) >= ACCEPTED)
    return rows.select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))
