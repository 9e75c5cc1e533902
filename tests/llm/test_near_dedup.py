"""Near-duplicates against brute force over all pairs."""

import re

import numpy as np
from pyspark.sql import functions as F

from terrane.llm import near_dedup


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else ())


def by_brute_force(rows, k, percent):
    """(component by doc_id, exact similarities of all linked pairs of texts)."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    different = {}
    for i, s in sets:
        different.setdefault(s, []).append(i)
    for ids in different.values():
        for i in ids[1:] if next(iter(different)) is not None else []:
            a, b = find(ids[0]), find(i)
            up[max(a, b)] = min(a, b)
    if frozenset() in different:
        for i in different.pop(frozenset()):
            if all(not s for j, s in sets if j == i):
                up[i] = i
    keys = list(different)
    for x in range(len(keys)):
        for y in range(x):
            both = len(keys[x] & keys[y])
            if both and 100 * both >= percent * len(keys[x] | keys[y]):
                a, b = find(different[keys[x]][0]), find(different[keys[y]][0])
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in up}


def held(spark, rows, plan):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(d, plan).collect()
    assert len(got) == len(rows)
    there = by_brute_force(rows, plan.shingle, plan.percent)
    sizes = sorted((str(i), len(shingles(t, plan.shingle))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == sizes
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert (r["component_id"], r["kept"]) == (there[r["doc_id"]], there[r["doc_id"]] == r["doc_id"])
    return there


def changed(words, n, rng, name):
    """words with n of them, apart from each other, replaced: each spoils k shingles."""
    out = list(words)
    for i, at in enumerate(rng.choice(np.arange(5, len(words) - 5, 4), n, replace=False)):
        out[at] = f"{name}{i}"
    return out


def test_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows, near = [], {}
    for i in range(40):
        # 200 shingles of three words; c changed words leave 200 - 3 c in common.
        words = [f"p{i}w{j}" for j in range(202)]
        rows.append((2 * i, " ".join(words)))
        c = (4, 5, 6, 8)[i % 4]
        rows.append((2 * i + 1, " ".join(changed(words, c, rng, f"q{i}x"))))
        a, b = shingles(rows[-2][1], 3), shingles(rows[-1][1], 3)
        near[2 * i + 1] = 100 * len(a & b) / len(a | b)
    assert any(85 <= v < 87 for v in near.values()) and any(82 < v < 85 for v in near.values())
    there = held(spark, rows, near_dedup.Plan(3, 85))
    assert all((there[i] != i) == (v >= 85) for i, v in near.items())


def test_large_buckets_in_small_blocks(spark):
    """Many texts just under the threshold, of which a few are linked across: no component is missed."""
    rng = np.random.default_rng(5)
    words = [f"w{j}" for j in range(202)]
    rows = [(i, " ".join(changed(words, 1 + i % 6, rng, f"c{i}x"))) for i in range(500)]
    rows += [(1000 + i, t) for i, t in rows[::9]]
    there = held(spark, rows, near_dedup.Plan(3, 85, block=64, part=16))
    assert 1 < len(set(there.values())) < 500


def test_odd_rows(spark):
    morse = ""
    for i in range(2048):
        morse += "ab"[bin(i).count("1") % 2]
    other = morse.translate(str.maketrans("ab", "ba"))
    a = " ".join(f"x{i}" for i in range(50))
    b = " ".join(f"y{i}" for i in range(50))
    rows = [
        (1, morse), (0, other),  # sums of powers of one base are equal for these two words
        (2, a), (5, a), (5, b), (7, b), (8, a.upper()),  # one doc_id with two texts links both
        (9, None), (10, ""), (11, " \n"), (12, "one"), (13, "One"), (14, "one two"), (14, "one two"),
        (None, a), (None, None), (20, " ".join(f"z{i}" for i in range(20000))),
    ]
    there = held(spark, rows, near_dedup.Plan(3, 85))
    assert (there[1], there[0], there[7], there[8], there[13]) == (1, 0, 2, 2, 12)


def test_other_columns_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 7, "z"), (2, "A b c d e f", 8, "z")], "doc_id int, text string, rep int, bucket string")
    got = near_dedup.near_duplicates(d).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == [1, 1]
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0


def test_sketches_rule_out_little_at_the_threshold():
    """Of pairs that share 85 % of 400 samples by chance the sketch keeps nearly all, of those at 70 % few."""
    rng = np.random.default_rng(7)
    plan = near_dedup.Plan(3, 85)

    def kept(share):
        n = 0
        for _ in range(400):
            same = rng.random(plan.samples) < share
            cells = rng.integers(0, near_dedup.SKETCH_BITS, (2, plan.samples))
            odd = np.bincount(cells[:, ~same].ravel(), minlength=near_dedup.SKETCH_BITS) & 1
            n += odd.sum() <= plan.most_odd
        return n / 400

    assert kept(0.85) >= 0.99 and kept(0.70) <= 0.1


def test_edges_of_components(spark):
    from terrane.llm.graph import components

    rng = np.random.default_rng(11)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).select("node", F.col("component")).distinct().collect()
    assert {r[0]: r[1] for r in got} == {a: find(a) for e in edges for a in e if e[0] != e[1]}
