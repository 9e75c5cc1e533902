"""Operators of DataFrame expressions against plain Python over the same texts."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import fingerprint, rules, secrets

WORD = r"[^\x20\x09-\x0D]+"


def test_secret_places(spark):
    """Every candidate, its place and the text on either side, as a scan by another engine finds them."""
    regex = pytest.importorskip("regex")
    key = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(900)]
    texts = [
        None, "", "no", 'a = "' + key[0] + '"', "key=" + key[1] + "==;x", "名前=" + key[2][:20] + "🎉🎉" + key[3][:12] + " é",
        " ".join(f"n{i}={k[: 6 + i % 40]}" for i, k in enumerate(key)), "x" * 40000, "password:\t'Abc123' token:abc12 token: abcdef",
        "".join(f"{k[:11]} " for k in key[:50]), "AKIA" + "ABCD1234" * 2, "a=b=c=" + key[4], "'" + key[5] + "==' " + key[6] + "===",
    ]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([*texts, texts[3]])], "doc_id int, text string, token string, start int")
    got = sorted((r["doc_id"], r["start"], r["end"], r["token"], r["before"], r["after"]) for r in secrets.candidates(d).collect())
    there = []
    assigns = regex.compile(r"^[\"'`]?[ \t]{0,4}[=:]+[ \t]{0,4}[\"'`]?$")
    for i, t in enumerate([*texts, texts[3]]):
        last, token = 0, ""
        for m in regex.finditer(secrets.CANDIDATE, t or ""):
            gap = t[last : m.start()]
            before = token + gap if assigns.match(gap) else gap
            nxt = regex.search(secrets.CANDIDATE, t, pos=m.end())
            after = t[m.end() : nxt.start() if nxt else len(t)]
            there.append((i, m.start(), m.end(), m[0], before[-secrets.CONTEXT :], after[: secrets.CONTEXT]))
            last, token = m.end(), m[0]
    assert len(there) > 900 and got == sorted(there)
    scored = secrets.scanned(d).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["secret_sha256"]) for r in scored) == sorted((i, a, b, hashlib.sha256(t.encode()).hexdigest()) for i, a, b, t, _, _ in there)
    assert secrets.scanned(d.limit(0)).count() == 0


def test_secret_features(spark):
    rng = np.random.default_rng(3)
    tokens = ["".join(rng.choice(list("abcXYZ019/._-+"), int(rng.integers(6, 60)))) for _ in range(200)]
    rows = [(t, "token = ", "") for t in tokens]
    d = spark.createDataFrame(rows, "t string, b string, a string").select("t", *secrets.features(F.col("t"), F.col("b"), F.col("a")))
    for r in d.collect():
        t = r["t"]
        kinds = re.sub("[^aB0]", ".", re.sub("[0-9]", "0", re.sub("[A-Z]", "B", re.sub("[a-z]", "a", t))))
        assert r["length"] == len(t) and r["transitions"] == pytest.approx(len(re.sub(r"(.)\1*", "x", kinds)) / len(t))
        assert r["digits"] == pytest.approx(sum(c.isdigit() for c in t) / len(t)) and r["distinct"] == pytest.approx(len(set(t)) / len(t))
        assert r["coverage"] == pytest.approx(1 - len(re.sub("|".join(secrets.DICTIONARY), "", t.lower())) / len(t))
        assert (r["secret_word"], r["assigned"], r["quoted"]) == (1.0, 1.0, 0.0)


def test_the_forest_on_formats_it_has_not_seen(spark):
    """Trained without three formats, the forest still tells them: findings are learned, not listed."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = secrets.labelled_findings(spark, 60).withColumn("h", F.pmod(F.xxhash64(F.substring("before", -6, 6)), F.lit(4))).cache()
    model = secrets.forest(found.filter("h <> 1"))
    rows = found.filter("h = 1").select(*secrets.features(F.col("token"), F.col("before"), F.col("after")), "label")
    rows = model.transform(VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(rows))
    right = rows.select(F.avg(((vector_to_array("probability")[1] >= 0.5).cast("int") == F.col("label")).cast("int"))).first()[0]
    assert found.filter("h = 1").count() > 100 and right > 0.85


def fence_by_hand(values, spread, low):
    cut = sorted((v >> max(v.bit_length() - 6, 0)) << max(v.bit_length() - 6, 0) for v in values)
    at = {t: next(v for i, v in enumerate(cut, 1) if 10 * i >= t * len(cut)) for t in (1, 5, 9)}
    return (at[1] - rules.WIDE * max(at[5] - at[1], spread) if low else -1, at[9] + rules.WIDE * max(at[9] - at[5], spread))


def test_rule_fences(spark):
    """kept, worked out by hand for large groups, a small one and a language that is small."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(700):
        lang, source = ("en", f"s{i % 3}") if i < 600 else ("de", "small" if i % 3 else "s0") if i < 670 else (None, "rare")
        n = int(rng.integers(15, 80))
        words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(1, 3 + i % 9)))) for _ in range(n)]
        if i % 11 == 0:
            words += ["#$%"] * int(rng.integers(0, 12))
        text = "".join(w + (" " if rng.random() < 0.9 else "\n") for w in words)
        if i % 13 == 0:
            text += "\nsame line\n" * int(rng.integers(1, 9))
        if i % 17 == 0:
            text += " one two three four five six seven eight nine ten" * 2
        rows.append((i, text, lang, source, 1))
    rows += rows[:5]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rows int")
    stats = {}
    for i, t, lang, source, _ in rows:
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        seen: dict = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        again = len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)})
        n, m = max(1, len(w)), max(1, len(lines))
        v = {"symbols": 1000 * len(re.findall(r"[#*$%&|<>]", t)) // n, "dup_lines": 1000 * (len(lines) - len(set(lines))) // m,
             "repeats": 1000 * again // n, "word_length": 1000 * sum(map(len, w)) // n}
        stats.setdefault(i, []).append((lang, source, len(w) < 20 or 100 * again > 30 * len(w), v))
    every = [x for xs in stats.values() for x in xs]
    kept = {}
    for i, xs in stats.items():
        lang, source, failed, v = xs[0]
        ok = not failed
        for k, (_, spread, low) in rules.STATISTICS.items():
            pools = ([y[3][k] for y in every if not y[2] and y[:2] == (lang, source)], [y[3][k] for y in every if not y[2] and y[0] == lang], [y[3][k] for y in every if not y[2]])
            values = next((p for p in pools[:2] if len(p) >= rules.MIN_ROWS), pools[2])
            a, b = fence_by_hand(values, spread, low)
            ok = ok and a <= v[k] <= b
        kept[i] = ok
    got = rules.ruled(d).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["kept"] for r in got} == kept
    assert 20 < sum(not r["base_failed"] and not r["kept"] for r in got) < 400
    # A corpus that is all rejected has no fences.
    assert rules.ruled(d.filter("doc_id < 0")).count() == 0 and rules.ruled(d.withColumn("text", F.lit("few"))).filter("kept").count() == 0


def test_rules_equal_their_sql(spark):
    """On the smaller tables the whole query and its SQL in another engine."""
    import os

    duckdb = pytest.importorskip("duckdb")
    from terrane.llm import queries

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    there = con.sql(queries.ORACLE_SQL["op5_adaptive_rules"])
    df = queries.op5_adaptive_rules(spark, folder)
    assert sorted(map(tuple, df.select(*there.columns).collect())) == sorted(there.fetchall())


def long_hash(values, seed=42):
    xxhash = pytest.importorskip("xxhash")
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return struct.unpack("<q", struct.pack("<Q", seed))[0]


def sketch(text):
    """All hashes of five-word shingles; windows of two, four and five words in turn."""
    w = re.findall(WORD, text)
    if len(w) < 5:
        return {long_hash([" ".join(w)])} if w else set()
    h = [long_hash([x]) for x in w]
    for step in (1, 2, 1):
        h = [long_hash([a, b]) for a, b in zip(h, h[step:], strict=False)]
    return set(h)


def test_sketches(spark):
    """Fingerprints hash for hash; likeness, containment and distinct counts against the sets themselves."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 700))))) for i in range(30)]
    base = rows[-1][1].split() * 2
    for i, share in enumerate((0.0, 0.02, 0.1, 0.3, 0.6)):
        words = [w if rng.random() >= share / 5 else f"new{k}" for k, w in enumerate(base)]
        rows.append((40 + i, " ".join(words)))
    rows += [(60, None), (61, ""), (62, " \n"), (63, "two words"), (64, "two  words")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprinted(d).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        a, b, c = sketch(t), sketch(edited), sketch(u)
        r = got[i]
        assert r["fingerprint"] == "".join(f"{h & (2**64 - 1):016x}" for h in sorted(a)[: fingerprint.K])
        assert r["edited_fingerprint"] == "".join(f"{h & (2**64 - 1):016x}" for h in sorted(b)[: fingerprint.K])
        for name, x, y in (("near_edited", a, b), ("near_next", a, c)):
            if not x or not y:
                assert r[name] == (1.0 if x == y else 0.0)
                continue
            least = set(sorted(set(sorted(x)[: fingerprint.K]) | set(sorted(y)[: fingerprint.K]))[: fingerprint.K])
            assert r[name] == pytest.approx(len(least & x & y) / len(least))
            assert abs(r[name] - len(x & y) / len(x | y)) < 0.2
        assert r["n_distinct_shingles"] == pytest.approx(len(a), rel=0.4)
        if a:
            assert abs(r["contained_in_edited"] - len(a & b) / len(a)) < 0.35


def test_sketches_of_parts_merge(spark):
    """The sketch of the whole is the merged sketch of parts that share no shingle across their border."""
    words = [f"w{i}" for i in range(2000)]
    a, b = " ".join(words[:1200]), " ".join(words[1196:])
    row = spark.createDataFrame([(a, b, " ".join(words))], "a string, b string, w string").select(
        fingerprint.merged(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("m"), fingerprint.fingerprint(F.col("w")).alias("w")
    ).first()
    assert row["m"] == row["w"] and len(row["w"]) == fingerprint.K


def test_crc_of_the_order(spark):
    """Texts and ids hash the same in either engine."""
    assert spark.sql("select crc32(cast('abc' as binary))").first()[0] == zlib.crc32(b"abc")
