"""Secret scans with a random forest that removes false positives.

Every whole text is scanned for strings that could be secrets: at least twelve
characters of those that keys are made of, or six after an assignment sign. The
name before an assignment sign is no part of the string. Each candidate gets
statistics of itself (length, transitions between kinds of characters, coverage
by dictionary words, path-likeness) and of its neighbouring words. A random forest
trained on labelled findings says which candidates are secrets. Scan, statistics,
training and scoring run on the JVM as DataFrame operations.

Labelled findings are a DataFrame (token, before, after, label); the built-in ones
are what the scan finds in texts made by rule from formats of keys and of strings
that are mistaken for them.

Not scanned: strings of under 12 characters that don't follow an assignment sign,
and of under six that do; a secret of several words; one that is broken by blanks.

Defined results: null and empty texts have no candidates; texts of any length are
scanned whole; repeated rows and repeated strings give a row each; a candidate
that ties with the threshold is a secret; an empty table gives an empty result;
columns besides doc_id and text are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import whole_text

_PART = r"[A-Za-z0-9+/_.~-]"
#: Where a value begins: an assignment sign, blanks, a quote.
_ASSIGNED = r"(?<=[=:][ \t]{0,4}[\"'`]?)"
_LONG = rf"(?:{_PART}{{12,}}+|{_ASSIGNED}{_PART}{{6,}}+)"
#: A string with the signs that base64 ends with; `=` before a value or its quote assigns, unless the string itself is quoted.
CANDIDATE = (
    rf"(?<!{_PART})(?:(?<=[\"'`]){_LONG}(?:={{1,2}}(?![={_PART[1:-1]}]))?"
    rf"|(?<![\"'`]){_LONG}(?:={{1,2}}(?![=\"'`{_PART[1:-1]}]))?)"
)
#: Characters of context on either side in which neighbouring words are looked for.
CONTEXT = 48
#: Candidates of a text whose places are summed in one piece.
CHUNK = 256
#: Words that names and placeholders in code are made of; a parameter of the features.
DICTIONARY = (
    "admin", "alpha", "and", "api", "app", "auth", "beta", "build", "change", "client", "code", "com", "config",
    "data", "default", "demo", "dev", "dummy", "example", "file", "for", "from", "home", "host", "http", "html",
    "image", "index", "insert", "key", "lib", "local", "mail", "main", "model", "name", "net", "note", "org",
    "page", "password", "path", "placeholder", "prod", "public", "release", "sample", "secret", "server", "service",
    "src", "static", "string", "system", "test", "text", "the", "this", "time", "token", "user", "value", "version",
    "web", "with", "www", "your",
)
SECRET_WORDS = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|private|credential|auth|bearer|signature)"
HARMLESS_WORDS = r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|revision|version|order|invoice|isbn|phone|card|account)"
FEATURES = (
    "length", "transitions", "coverage", "letters", "digits", "upper", "hex", "distinct", "slashes", "dots",
    "filler", "secret_word", "harmless_word", "assigned", "quoted", "mail", "uuid", "path", "host",
)


def features(token: Column, before: Column, after: Column) -> list[Column]:
    """The forest's inputs, named after FEATURES."""
    n = F.length(token).cast("double")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(token, pattern, "")) / n

    kinds = token
    for pattern, kind in (("[a-z]", "a"), ("[A-Z]", "B"), ("[0-9]", "0"), ("[^aB0]", ".")):
        kinds = F.regexp_replace(kinds, pattern, kind)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "x"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values = {
        "length": n,
        "transitions": runs / n,
        "coverage": 1 - F.length(F.regexp_replace(F.lower(token), "|".join(DICTIONARY), "")) / n,
        "letters": share("[^A-Za-z]+"),
        "digits": share("[^0-9]+"),
        "upper": share("[^A-Z]+"),
        "hex": share("[^0-9a-fA-F]+"),
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / n,
        "slashes": share("[^/]+"),
        "dots": share("[^._~-]+"),
        "filler": flag(token.rlike(r"(.)\1{4}|(?i)1234|abcd|x{3}")),
        "secret_word": flag(before.rlike(SECRET_WORDS)),
        "harmless_word": flag(before.rlike(HARMLESS_WORDS)),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        "mail": flag(before.rlike("@$") | after.startswith("@")),
        "uuid": flag(token.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "path": flag(token.rlike(r"^\.{0,2}/|/[A-Za-z0-9_.-]+/|\.[a-z]{2,4}$") | before.rlike(r"[/\\]$")),
        "host": flag(token.rlike(r"^[0-9.]+$") | token.rlike(r"(?i)\.(com|org|net|io)\b")),
    }
    return [values[k].cast("double").alias(k) for k in FEATURES]


def candidates(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, start, end, token, before, after of each candidate, and more columns; positions in code points."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("string").alias("text"), *more)
    cut = text.filter(F.col("text").rlike(CANDIDATE)).select(
        "doc_id",
        *more,
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("tokens"),
        F.split("text", CANDIDATE, -1).alias("gaps"),
    )
    # Where each candidate starts: the sum of what lies before it. Arrays are copied when
    # they grow, so sums are taken in pieces of CHUNK candidates and the pieces joined.
    pairs = F.arrays_zip("tokens", "gaps")
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("gaps") / CHUNK).cast("int")), lambda i: F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK))
    )
    none = F.array().cast("array<int>")
    sums = F.transform(
        pieces,
        lambda piece: F.aggregate(
            piece,
            F.struct(F.lit(0).alias("at"), none.alias("starts")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["gaps"]) + F.coalesce(F.length(x["tokens"]), F.lit(0))).alias("at"),
                F.concat(a["starts"], F.array(a["at"] + F.length(x["gaps"]))).alias("starts"),
            ),
        ),
    )
    starts = F.flatten(
        F.aggregate(
            sums,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("starts")),
            lambda a, x: F.struct(
                (a["at"] + x["at"]).alias("at"), F.concat(a["starts"], F.array(F.transform(x["starts"], lambda s: s + a["at"]))).alias("starts")
            ),
        )["starts"]
    )
    # A name long enough to be a candidate stands before the value that is assigned to it.
    named = F.zip_with(
        "gaps",
        F.concat(F.array(F.lit("")), F.col("tokens")),
        lambda g, t: F.when(g.rlike(r"^[\"'`]?[ \t]{0,4}[=:]+[ \t]{0,4}[\"'`]?$"), F.concat(t, g)).otherwise(g),
    )
    return (
        cut.select(
            "doc_id",
            *more,
            F.explode(
                F.arrays_zip(
                    F.col("tokens").alias("token"),
                    F.slice(starts, 1, F.size("tokens")).alias("start"),
                    F.transform(F.slice(named, 1, F.size("tokens")), lambda g: F.right(g, F.lit(CONTEXT))).alias("before"),
                    F.transform(F.slice("gaps", 2, F.size("tokens")), lambda g: F.left(g, F.lit(CONTEXT))).alias("after"),
                )
            ).alias("x"),
        )
        .select("doc_id", *more, "x.token", "x.start", "x.before", "x.after")
        .withColumn("end", F.col("start") + F.length("token"))
    )


def labelled_findings(spark: SparkSession, each: int = 120) -> DataFrame:
    """What the scan finds in texts made by rule, `each` of every format: 1 for secrets and 0 for others."""
    n = F.col("id")

    def digest(salt: str) -> Column:
        return F.sha2(F.concat(n.cast("string"), F.lit(salt)).cast("binary"), 256)

    hex40, hex64 = F.left(digest("a"), F.lit(40)), digest("b")
    b64 = F.regexp_replace(F.base64(F.unhex(digest("c"))), "=+$", "")
    number = F.regexp_replace(F.conv(F.left(digest("d"), F.lit(15)), 16, 10), "^0+", "")
    word = F.element_at(F.array(*map(F.lit, DICTIONARY)), (n % len(DICTIONARY) + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, DICTIONARY)), (n * 7 % len(DICTIONARY) + 1).cast("int"))
    uuid = F.concat_ws("-", *(F.substring(digest("e"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    letters = F.translate(b64, "0123456789+/", "qWeRtYuIoPaS")
    small = F.translate(digest("g"), "0123456789", "ghiklmnoprstu")
    formats = [
        (1, 'const token = "', hex40, '";'),
        (1, "let auth_token = \"", hex40, '", null)'),
        (1, "api_key: ", hex40, " "),
        (1, "export SECRET_KEY='", b64, "'\n"),
        (1, "aws_access_key_id=", F.concat(F.lit("AKIA"), F.upper(F.left(F.translate(b64, "+/", "XY"), F.lit(16)))), "\n"),
        (1, "Authorization: Bearer ", F.concat(F.lit("ghp_"), F.left(F.translate(b64, "+/", "Qz"), F.lit(36))), "\n"),
        (1, 'password = "', F.left(b64, F.lit(14)), '"'),
        (1, "client_secret=", F.concat(F.lit("sk-"), F.left(hex64, F.lit(48))), "&"),
        (1, "value \"", F.left(b64, F.lit(40)), "\";"),
        (1, "token: ", F.left(letters, F.lit(24)), "\n"),
        (1, "secret='", F.left(letters, F.lit(32)), "'"),
        (1, "password=", F.concat(F.left(b64, F.lit(6)), number), "\n"),
        (1, "password=", F.concat(F.initcap(other), F.left(number, F.lit(1)), F.left(b64, F.lit(4))), "\n"),
        (1, "db_password: ", F.left(b64, F.lit(10)), "\n"),
        (1, "api_key=", b64, "\n"),
        (1, "https://host/x?access_token=", hex40, "&y=1"),
        (0, "commit ", hex40, "\nAuthor"),
        (0, "sha256: ", hex64, " "),
        (0, "md5 checksum = \"", F.left(hex64, F.lit(32)), '"'),
        (0, "with uuid ", uuid, " in"),
        (0, 'id = "', uuid, '"'),
        (0, "the ", F.left(F.rpad(number, 16, "7"), F.lit(16)), " of"),
        (0, "card ", F.left(F.rpad(number, 16, "7"), F.lit(16)), " and"),
        (0, " of ", F.concat_ws(".", *((F.conv(F.substring(digest("f"), a, 2), 16, 10).cast("int") % 156 + 100).cast("string") for a in (1, 3, 5, 7))), " is"),
        (0, "jane.doe@", F.concat(F.lit("mail"), (n % 10).cast("string"), F.lit(".example.com")), " and"),
        (0, "to ", F.concat(word, other, F.lit("."), (n % 99 + 1).cast("string")), "@mail3.example.com"),
        (0, "see ", F.concat(F.lit("/usr/"), word, F.lit("/"), other, (n % 99).cast("string"), F.lit(".html")), " for"),
        (0, "https:", F.concat(F.lit("//www."), word, other, F.lit(".com/page"), n.cast("string")), " "),
        (0, 'token = "', F.concat_ws("_", F.lit("your"), word, other, F.lit("here"), (n % 10).cast("string")), '"'),
        (0, "password: ", F.concat(F.repeat(F.lit("x"), 12), (n % 10).cast("string")), "\n"),
        (0, "api_key = '", F.concat(F.lit("example-"), word, F.lit("-1234567890")), "'"),
        (0, "version ", F.concat(F.lit("release-"), (n % 9).cast("string"), F.lit("."), (n % 31).cast("string"), F.lit(".0-"), word), " "),
        (0, "the ", F.left(small, (n % 9 + 12).cast("int")), " of"),
        (0, "Of ", F.initcap(F.left(small, (n % 9 + 12).cast("int"))), " the"),
        (0, "THE ", F.upper(F.left(small, (n % 9 + 12).cast("int"))), " OF"),
        (0, ".!! ", F.upper(F.substring(small, 20, 14)), "!! "),
        (0, "NOTE: ", F.upper(F.left(small, (n % 9 + 6).cast("int"))), " OF"),
        (0, "the ", F.concat(F.initcap(F.left(small, F.lit(7))), F.initcap(F.substring(small, 8, 7))), " of"),
        (0, "call ", F.concat_ws("_", F.left(small, F.lit(4)), word, F.substring(small, 5, 6)), "("),
        (0, "the ", F.concat_ws("-", F.left(small, F.lit(5)), other, F.substring(small, 6, 5)), ", and"),
        (0, "note: ", F.left(small, F.lit(8)), " and"),
        (0, "password: ", F.concat_ws(" ", word, F.left(small, F.lit(7))), " is"),
        (0, "mode=", F.concat_ws("_", word, other, F.left(small, F.lit(3))), "\n"),
        (0, "token: ", F.concat(F.lit("required-"), word), "\n"),
        (0, "count = ", F.left(number, F.lit(7)), "\n"),
        (0, "\n", F.repeat(F.element_at(F.array(*map(F.lit, "-._~+/")), (n % 6 + 1).cast("int")), (n % 40 + 12).cast("int")), "\n"),
        (0, "on ", F.concat(F.lit("2024-0"), (n % 9 + 1).cast("string"), F.lit("-11T10:30:00.00"), (n % 9).cast("string")), " the"),
    ]
    made = spark.range(0, each, 1, 1).select(F.posexplode(F.array(*(
        F.struct(F.concat(F.lit(b), t, F.lit(a)).alias("text"), F.lit(len(b)).alias("at"), F.length(t).alias("n"), F.lit(y).alias("label"))
        for y, b, t, a in formats
    ))).alias("pos", "x"), (n * len(formats)).alias("first")).select((F.col("first") + F.col("pos")).alias("doc_id"), "x.*")
    # The secret itself, whole, is one; all else that the scan finds in these texts is none.
    found = candidates(made, "at", "n", "label")
    whole = (F.col("start") == F.col("at")) & (F.length("token") == F.col("n"))
    return found.select("token", "before", "after", F.when(whole, F.col("label")).otherwise(0).alias("label"))


def forest(findings: DataFrame, trees: int = 30, depth: int = 7):
    """A random forest fitted to labelled findings (token, before, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.filter("token is not null and label in (0, 1)").select(
        *features(F.col("token"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))), F.col("label").cast("double")
    )
    inputs = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=7, featureSubsetStrategy="sqrt").fit(inputs)


def scanned(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Each candidate's place, digest, score and verdict; the string itself isn't returned."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model = forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    found = candidates(docs)
    rows = found.select(
        "doc_id", "start", "end", F.sha2(F.col("token").cast("binary"), 256).alias("secret_sha256"),
        *features(F.col("token"), F.col("before"), F.col("after")),
    )
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    score = vector_to_array("probability")[1]
    return model.transform(rows).select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        "secret_sha256",
        score.alias("score"),
        (score >= threshold).alias("is_secret"),
    )
