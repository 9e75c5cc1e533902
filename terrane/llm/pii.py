"""PII by pattern, and by what the corpus says a term gives away.

Base spans are found by pattern in every whole text. Each distinct value found is
a protected entity. All words of the texts that hold an entity are candidate
terms; a term's disclosure is estimated over the corpus, in whole texts:

    posterior = texts that hold both / texts that hold the term
    bits      = log2(posterior / (texts that hold the entity / all texts))

A term that occurs with one entity in at least `support` different texts, or near
its mentions (eight whole words on either side in the line) in as many different
contexts, and passes both thresholds reveals that entity. Every occurrence of it,
in any text, becomes a span of kind `term`; sanitising generalises it to the kind
of entity that it reveals, or removes it where the posterior is near certain.
Copies of a text or of a context count once.

Texts that hold entities and candidate terms are marked in tables of fixed size,
and words too common for any entity of a text are left out of it, only to spare
the later passes most words; the counts come from exact joins. A text is known by
128 bits of its SHA-256.

Defined results: a null text is empty and stays null when sanitised; texts of any
length are read whole; nulls and repeated rows keep their rows, each answered for
itself; spans that begin at one place are listed by kind, and where spans overlap
the first, or at one place the longest, names what is replaced; an empty table
gives an empty result, a corpus without protected entities has no terms; columns
besides doc_id and text are only carried along, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from terrane.llm.common import discard, mapped, stage, unused, whole_text

#: Kinds of base spans, in the order in which ties are listed; then terms.
KINDS = ("email", "ip", "card", "phone", "term")
#: Cells that texts and candidate terms are marked in.
TEXT_CELLS, TERM_CELLS = 1 << 20, 1 << 24
#: Entries that a task holds of texts or words that it has seen.
HELD = 1 << 18
#: Words on either side of a mention that count as near.
NEAR = 8
#: So many of the commonest words are left out early; the others go by the exact counts.
COMMON = 100_000
#: Up to so many revealing terms are sent to the tasks; more are joined.
SENT = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_NOT_DIGIT = re.compile(r"[^0-9]")


@dataclass(frozen=True)
class Disclosure:
    support: int = 3
    posterior: float = 0.8
    bits: float = 2.0
    #: From here on a term is removed rather than generalised.
    certain: float = 0.95


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost e-mail addresses, in time linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", found.end() if found else at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; positions in code points."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0]) if len(m[0]) < 64 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in out]


def entity(value: str, kind: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def words_of(text: str) -> set[str]:
    """The different words of a text, each lowered by itself (some characters lower otherwise beside others)."""
    return set(_TERM.findall(text.lower())) if text.isascii() else {m.lower() for m in set(_TERM.findall(text))}


def near_terms(text: str, spans: list[tuple[int, int, str]]):
    """(entity, term, context) for each mention and each whole word near it in its line."""
    if not spans:
        return
    found = [m.span() for m in _TERM.finditer(text)]
    starts, ends = [a for a, _ in found], [b for _, b in found]
    for start, end, kind in spans:
        first = text.rfind("\n", 0, start) + 1
        stop = text.find("\n", end)
        k = bisect_right(ends, start)
        left = [w for w in found[max(0, k - NEAR) : k] if w[0] >= first]
        k = bisect_left(starts, end)
        right = [w for w in found[k : k + NEAR] if stop < 0 or w[1] <= stop]
        near = [text[a:b].lower() for a, b in (*left, *right)]
        context = zlib.crc32(" ".join(near).encode())
        name = entity(text[start:end], kind)
        for term in set(near):
            yield name, term, context


def base_table(docs: DataFrame) -> DataFrame:
    """text_key, entities and near (entity, term, context) of each row that holds an entity."""

    def run(batches):
        import pyarrow as pa

        near = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("context", pa.int64())]))
        for batch in batches:
            keys, names, terms = [], [], []
            for key, whole in zip(batch.column(1), batch.column(2), strict=True):
                text = whole.as_py()
                if spans := base_spans(text):
                    keys.append(key.as_py())
                    names.append(sorted({entity(text[a:b], k) for a, b, k in spans}))
                    terms.append([dict(zip(("entity", "term", "context"), x, strict=True)) for x in near_terms(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(names, pa.list_(pa.string())), pa.array(terms, near)],
                names=["text_key", "entities", "near"],
            )

    return mapped(keyed(docs), run, "text_key binary, entities array<string>, near array<struct<entity: string, term: string, context: long>>"
    )


def text_key():
    return F.substring(F.unhex(F.sha2(whole_text().cast("string").cast("binary"), 256)), 1, 16)


def keyed(docs: DataFrame) -> DataFrame:
    text = whole_text().cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text.alias("text"))


def least_counts(docs: DataFrame) -> DataFrame:
    """(term, least): so many different texts hold a word at the least.

    Each task counts its own different texts, HELD words or texts at a time, and
    gives a row for each word; the greatest of these counts is a lower bound for
    the corpus.
    """

    def run(batches):
        import pyarrow as pa

        texts: set[bytes] = set()
        counts: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"]
            )

        for batch in batches:
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key in texts:
                    continue
                texts.add(key)
                for word in words_of(text.as_py()):
                    counts[word] = counts.get(word, 0) + 1
                if len(counts) >= HELD or len(texts) >= HELD:
                    yield out()
                    texts, counts = set(), {}
        yield out()

    return mapped(keyed(docs), run, "term string, n long").groupBy("term").agg(F.max("n").alias("least"))


def marked(cells: DataFrame, size: int) -> bytes:
    """Bits of the cells (column c): rows of 4 KB reach the driver, size / 32768 of them at most."""
    rows = (
        cells.groupBy(F.expr("bitmap_bucket_number(c + 1)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c + 1))").alias("bits"))
        .collect()
    )
    out = bytearray(size // 8 + 4096)
    for r in rows:
        at = (r["bucket"] - 1) * 4096  # buckets of 32768 cells count from 1
        out[at : at + 4096] = r["bits"]
    return bytes(out)


def is_marked(bits: bytes, cell: int) -> bool:
    return bool(bits[cell >> 3] >> (cell & 7) & 1)


def text_terms(docs: DataFrame, held: DataFrame, common: dict[str, int], posterior: float) -> DataFrame:
    """(text_key, entities, terms) of each different text in held, without the words
    that are in too many texts (common: at the least) to reach the posterior there.

    A term is free where it stands outside of all base spans once at least. What
    is known of a text's entities is, in its cell, a power of two that none of
    them passes in texts.
    """
    most = F.aggregate("entities", F.lit(0).cast("long"), lambda a, e: F.greatest(a, e["with_entity"]))
    cell = F.crc32("text_key") % TEXT_CELLS
    tops = stage(held.groupBy(cell.alias("c")).agg(F.ceil(F.log2(F.max(most))).cast("int").alias("power")), "pii-cells")
    levels = bytearray(TEXT_CELLS)
    for (power,) in tops.select("power").distinct().sort("power").collect():
        bits = marked(tops.filter(F.col("power") == power), TEXT_CELLS)
        for at, byte in enumerate(bits):
            if byte:
                for k in range(8):
                    if byte >> k & 1:
                        levels[8 * at + k] = power + 1
    bounds = bytes(levels)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("term", pa.string()), ("free", pa.bool_())]))
        texts: set[bytes] = set()
        for batch in batches:
            keys: list[bytes] = []
            lists: list[list[dict]] = []
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                power = bounds[zlib.crc32(key) % TEXT_CELLS]
                if not power or key in texts:
                    continue
                if len(texts) >= HELD:  # a text met again is left out later
                    texts = set()
                texts.add(key)
                bound = 1 << (power - 1)
                whole = text.as_py()
                parts, at = [], 0
                for a, b, _ in base_spans(whole):
                    parts.append(whole[at : max(a, at)])
                    at = max(at, b)
                # Words cut by a span are not free; what a cut leaves of one is no word of the text.
                free = words_of("@".join([*parts, whole[at:]]))
                found = words_of(whole)
                keys.append(key)
                lists.append([{"term": w, "free": w in free} for w in found if bound >= posterior * common.get(w, 0)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lists, kind)], names=["text_key", "terms"])

    words = mapped(keyed(docs), run, "text_key binary, terms array<struct<term: string, free: boolean>>").filter(F.size("terms") > 0)
    return words.dropDuplicates(["text_key"]).join(held, "text_key")


def holders(docs: DataFrame, bits: bytes) -> DataFrame:
    """text_key, term: the words of each text whose cell is marked."""

    def run(batches):
        import pyarrow as pa

        seen: dict[str, bool] = {}

        def hit(word: str) -> bool:
            found = seen.get(word)
            if found is None:
                if len(seen) >= HELD:
                    seen.clear()
                found = seen[word] = is_marked(bits, zlib.crc32(word.encode()) % TERM_CELLS)
            return found

        for batch in batches:
            keys, terms = [], []
            for key, text in zip(batch.column(1), batch.column(2), strict=True):
                own = list(filter(hit, words_of(text.as_py())))
                keys += [key.as_py()] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(terms, pa.string())], names=["text_key", "term"])

    return mapped(keyed(docs), run, "text_key binary, term string")


def revealing(docs: DataFrame, rule: Disclosure | None = None) -> DataFrame | None:
    """(term, posterior, bits, kind): terms and the kind of entity that they reveal most surely.

    None where no text holds an entity with a candidate.
    """
    rule = rule or Disclosure()
    base = stage(base_table(docs), "pii-base")
    near = base.filter(F.size("near") > 0).select(F.explode("near").alias("x")).select("x.*").distinct()
    pairs = stage(
        near.groupBy("entity", "term")
        .agg(F.count("*").alias("contexts"))
        .filter(F.col("contexts") >= rule.support)
        .select("entity", "term"),
        "pii-pairs",
    )
    mentions = base.select("text_key", F.explode("entities").alias("entity")).distinct()
    total = docs.select(text_key().alias("text_key")).distinct().count()
    # An entity in too few texts has near terms only; one in too many reveals too few bits with any term.
    with_entity = mentions.groupBy("entity").agg(F.count("*").alias("with_entity"))
    with_entity = with_entity.join(pairs.select("entity", F.lit(True).alias("_near")).distinct(), "entity", "left")
    with_entity = with_entity.filter(
        (F.log2(F.lit(float(total)) / F.col("with_entity")) >= rule.bits)
        & ((F.col("with_entity") >= rule.support) | F.col("_near"))
    )
    with_entity = stage(with_entity.drop("_near"), "pii-entities")
    held = mentions.join(with_entity, "entity").groupBy("text_key")
    held = stage(held.agg(F.collect_list(F.struct("entity", "with_entity")).alias("entities")), "pii-held")
    if held.isEmpty():
        return None
    least = stage(least_counts(docs).filter(F.col("least") >= rule.support), "pii-least")
    common = {r["term"]: r["least"] for r in least.orderBy(F.desc("least")).limit(COMMON).collect()}
    together = (
        text_terms(docs, held, common, rule.posterior)
        .select("terms", F.explode("entities").alias("e"))
        .select("e.entity", "e.with_entity", F.explode("terms").alias("t"))
        .groupBy("entity", "with_entity", F.col("t.term").alias("term"))
        .agg(F.count("*").alias("both"), F.count_if("t.free").alias("free"))
    )
    # Words too common to reach the posterior go before the texts that hold them are listed.
    together = (
        together.join(pairs.withColumn("_near", F.lit(True)), ["entity", "term"], "left")
        .filter((F.col("free") >= rule.support) | F.col("_near"))
        .join(least, "term", "left")
        .filter(F.col("both") >= rule.posterior * F.coalesce("least", F.lit(0)))
    )
    together = stage(together.select("entity", "with_entity", "term", "both"), "pii-possible")
    if together.isEmpty():
        return None
    bits = marked(together.select((F.crc32(F.col("term").cast("binary")) % TERM_CELLS).alias("c")), TERM_CELLS)
    seen = holders(docs, bits).distinct()
    with_term = seen.groupBy("term").agg(F.count("*").alias("with_term"))
    terms = (
        together.join(with_term, "term")
        .withColumn("posterior", F.col("both") / F.col("with_term"))
        .withColumn("bits", F.log2(F.col("posterior") * F.lit(float(total)) / F.col("with_entity")))
        .filter((F.col("posterior") >= rule.posterior) & (F.col("bits") >= rule.bits))
        .groupBy("term")
        .agg(F.max(F.struct("posterior", "bits", F.substring_index("entity", ":", 1).alias("kind"))).alias("x"))
        .select("term", "x.*")
    )
    out = stage(terms, "pii-terms")
    discard(base, pairs, with_entity, held, least, together)
    return out


def term_spans(text: str, spans: list[tuple[int, int, str]], terms: dict) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words of a text that are terms, outside of its base spans."""
    if not terms or terms.keys().isdisjoint(words_of(text)):
        return []
    out, k = [], 0
    by_start = sorted(spans)
    reach = 0
    for m in _TERM.finditer(text):
        word = m[0].lower()
        if word in terms:
            while k < len(by_start) and by_start[k][0] < m.end():
                reach = max(reach, by_start[k][1])
                k += 1
            if reach <= m.start():
                out.append((m.start(), m.end(), word))
    return out


def with_terms(docs: DataFrame, terms: DataFrame | None, sent: int = SENT):
    """(docs with a column `of`, what tasks know): the terms of a text, by a closure or by a join.

    The closure holds at most `sent` terms; where there are more, each text that
    holds some gets them as a map in the column `of`, joined on the text's key.
    """
    of = unused(docs.columns, "of")
    none = F.lit(None).cast("map<string, struct<posterior: double, kind: string>>")
    if terms is None:
        return docs.withColumn(of, none), of, {}
    if terms.count() <= sent:
        return docs.withColumn(of, none), of, {r["term"]: (r["posterior"], r["kind"]) for r in terms.collect()}
    key = unused([*docs.columns, of], "key")
    bits = marked(terms.select((F.crc32(F.col("term").cast("binary")) % TERM_CELLS).alias("c")), TERM_CELLS)
    own = (
        holders(docs, bits).distinct().join(terms, "term")
        .groupBy(F.col("text_key").alias(key))
        .agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("posterior", "kind")))).alias(of))
    )
    return docs.withColumn(key, text_key()).join(own, key, "left").drop(key), of, {}


def found_spans(docs: DataFrame, rule: Disclosure | None = None, sent: int = SENT) -> DataFrame:
    """Counts and digests of each row's spans."""
    import hashlib

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("string").alias("text"))
    rows, of, known = with_terms(narrow, revealing(narrow, rule), sent)
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_term"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                base = base_spans(text)
                terms = term_spans(text, base, known or dict(own.as_py() or ()))
                listed = [f"{k}:{a}:{b}" for a, b, k in base]
                every = sorted([*base, *((a, b, KINDS[4]) for a, b, _ in terms)], key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if terms else base
                kinds = [k for _, _, k in base]
                out.append((
                    *(kinds.count(k) for k in KINDS[:4]),
                    hashlib.sha256(",".join(listed).encode()).hexdigest(),
                    ",".join(f"{k}:{a}:{b}" for a, b, k in every),
                    len(terms),
                ))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return mapped(rows.select("doc_id", "text", of), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long"
    )


def sanitised(docs: DataFrame, rule: Disclosure | None = None, sent: int = SENT) -> DataFrame:
    """docs with its columns, each span of its text replaced and n_chars as it is now.

    Base spans become <EMAIL> and the like; a revealing term is generalised to the
    kind of entity that it reveals (<EMAIL-TERM>), or removed where its posterior
    is near certain. Overlapping spans are replaced as one, named after the first.
    A null text stays null.
    """
    rule = rule or Disclosure()
    rows, of, known = with_terms(docs, revealing(docs, rule), sent)
    certain = rule.certain

    def replaced(texts, own):
        import pandas as pd

        out = []
        for text, more in zip(texts, own, strict=True):
            if not text:
                out.append(text)
                continue
            base = base_spans(text)
            terms = known or ({k: tuple(v.values()) if isinstance(v, dict) else tuple(v) for k, v in dict(more).items()} if more is not None else {})
            marks = [(a, b, f"<{k.upper()}>") for a, b, k in base]
            for a, b, word in term_spans(text, base, terms) if terms else ():
                posterior, kind = terms[word]
                marks.append((a, b, "" if posterior >= certain else f"<{kind.upper()}-TERM>"))
            if not marks:
                out.append(text)
                continue
            parts, at = [], 0
            for a, b, name in sorted(marks, key=lambda m: (m[0], -m[1])):
                if a >= at:
                    parts += [text[at:a], name]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    replace_all = F.pandas_udf(replaced, "string", functionType=PandasUDFType.SCALAR)
    changed = {"text": replace_all(F.col("text").cast("string"), F.col(of))}
    out = rows.withColumns(changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(whole_text()).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))
