"""Token ids in binary segments, by an adaptive context-mixing range coder.

A segment holds whole documents. Its ids are renamed to ranks by falling frequency
and cut into blocks, each coded from a fresh state and checksummed, so that damage
stays in its block. All blocks of a segment are coded in lockstep, one NumPy lane
each.

Three orders predict each id from the block's own past. Order 2 and order 1 each
name an id, the one that last followed the previous two ids or the previous one,
with a count of how often in a row it was right. Order 0 gives every id a share:
adaptive frequencies of the classes of ranks (class k: the 2**k ranks from
2**k - 1 on), and even shares within a class, whose ids are about equally frequent
since ranks follow frequency. The three are mixed into one distribution,

    P(x) = p2 [x = named by order 2] + (1 - p2) (p1 [x = named by order 1] + (1 - p1) P0(x)),

where p2 and p1 adapt to how well predictions with the same count did in the block.
A range coder of 62 bits with carries and output of 16 bits turns P into bytes.

Segment layout, little endian: magic, version u16, block size u32, documents u32,
ids u64, blocks u32, bytes of the two tables u32 each, CRC-32 of all that and
the tables u32; tables (zlib): per document a null flag u8, doc_id i64, ids u32;
ranks as ids u32; then per block words u32, ids u32, CRC-32 of its ids as u32s;
then the blocks' words u16.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.bpe import ROWS, tokenizer_path, transducer
from terrane.llm.common import mapped, stage

MAGIC = b"TRNC"
VERSION = 3
HEAD = "<4sHIIQIII"
#: Ids of a block at most and at least, blocks that a segment should have, ids of a segment.
BLOCK, LEAST, LANES = 4096, 512, 2048
SEGMENT = 4 << 20
#: Id after each document.
END_ID = 1
#: Runs that the tokeniser's memo holds: those of several segments, so that most of a segment's are known from those before.
MEMO = 1 << 20

U = np.uint64
#: Places of the tables of orders 1 and 2, by a hash of the context; counts of right predictions.
_SLOTS, _RIGHT = 512, 16
#: Tables lie this far apart: at a power of two, lanes would push each other out of the processor's cache.
_STRIDE = _SLOTS + 8
#: Bits of a probability; the steps of the adaptive ones as shifts; the most that a mixed share may be.
_BITS, _FAST, _SLOW = 14, 5, 5
#: Frequencies of classes take up so many ids at a time, fewer than 1 << _SLOW.
_PERIOD = 8
_ONE = 1 << _BITS
_LOW, _HIGH = _ONE >> 9, _ONE - (_ONE >> 7)
_SPAN = _HIGH - _LOW
#: An interval is widened when it gets smaller; so many bits may be used by one id.
_SMALL = 1 << 46
_MASK = _SMALL - 1
#: Offsets of more bits than this in a class are coded in a step of their own.
_WIDE = 18


class DamagedBlock(ValueError):
    pass


class Model:
    """What coder and decoder both know before each id; one lane per block.

    All is kept in longs, so that no array changes its type along the way, and
    choices are masks of all bits or none, which cost a fifth of NumPy's where.
    """

    def __init__(self, lanes: int, classes: int) -> None:
        self.lanes, self.classes = lanes, classes
        self.lane = np.arange(lanes)
        self.place = self.lane * _STRIDE
        #: Id named, times 16, plus how often in a row it was right.
        self.t1 = np.zeros(lanes * _STRIDE, np.int32 if classes < 27 else np.int64)
        self.t2 = np.zeros_like(self.t1)
        #: By count, then by lane: counts are small mostly, and what is read lies together.
        self.p1 = np.repeat((np.arange(_RIGHT) + 1) * (_ONE // 20), lanes)
        self.p2 = np.repeat((np.arange(_RIGHT) + 2) * (_ONE // 20), lanes)
        #: Cumulative frequencies of the classes without the floor of one each: all alike at first.
        self.free = _ONE - classes - 1
        self.edge = np.arange(classes + 1, dtype=np.int32)[:, None]
        self.cum = np.repeat(self.edge * np.int32(self.free // classes), lanes, axis=1)
        self.cum[-1] = self.free
        #: How many of the ids since the last time lay below each edge; hits lie below all.
        self.low_edge = self.edge.astype(np.int8)
        self.below = np.zeros(self.cum.shape, np.int8)
        self.above = np.empty(self.cum.shape, bool)
        self.seen = 0
        self.spread()

    def places(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the tables of orders 1 and 2 after x, and y before it."""
        return (x & (_SLOTS - 1)) + self.place, ((x * 0x9E3779B1 + (y * 0x9E3779B1 >> 7) * 5) >> 15 & (_SLOTS - 1)) + self.place

    def look(self, at1: np.ndarray, at2: np.ndarray) -> None:
        """What orders 2 and 1 name, with what weight."""
        self.at1, self.at2 = at1, at2
        self.e1, self.e2 = self.t1[at1].astype(np.int64), self.t2[at2].astype(np.int64)
        self.c1, self.c2 = self.e1 & 15, self.e2 & 15
        self.row1, self.row2 = self.c1 * self.lanes + self.lane, self.c2 * self.lanes + self.lane
        self.w1, self.w2 = self.p1[self.row1], self.p2[self.row2]
        # Where both name the same id order 1 has no say.
        self.other = 15 - (self.e1 ^ self.e2) >> 63
        self.m1 = self.w1 & self.other

    def spread(self) -> None:
        """Start and width of each class among the classes, of _ONE in all."""
        starts = self.cum + self.edge
        self.first = starts[:-1].astype(np.int64).reshape(-1)
        self.width = (starts[1:] - starts[:-1]).astype(np.int64).reshape(-1)
        self.inner = starts[1:-1].astype(np.int16)

    def learn(self, plain: np.ndarray, k: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """plain is the id times 16, k its class; masks: hit1 where order 1 named it, whatever order 2 said."""
        self.p2[self.row2] = self.w2 + ((hit2 & _SPAN) + _LOW - self.w2 >> _FAST)
        self.p1[self.row1] = self.w1 + (((hit1 & _SPAN) + _LOW - self.w1 >> _FAST) & self.other & ~hit2)
        self.t2[self.at2] = (plain + (np.minimum(self.c2 + 1, _RIGHT - 1) & hit2)).astype(self.t2.dtype)
        self.t1[self.at1] = (plain + (np.minimum(self.c1 + 1, _RIGHT - 1) & hit1)).astype(self.t1.dtype)
        # Only where neither order named the id: the class becomes likelier.
        np.greater(self.low_edge, (k | hit2 | hit1).astype(np.int8), out=self.above)
        np.add(self.below, self.above.view(np.int8), out=self.below)
        self.seen += 1
        if self.seen == _PERIOD:
            below = (self.below - self.below[0]).astype(np.int32)
            self.cum += below * np.int32(self.free) - below[-1] * self.cum >> _SLOW
            self.below[:] = 0
            self.seen = 0
            self.spread()


def _classes(names: int) -> int:
    return max(1, int(names).bit_length())


def encode_blocks(ranks: np.ndarray, names: int) -> list[np.ndarray]:
    """Words of each lane of ranks (lanes, ids), all below names."""
    lanes, n = ranks.shape
    model, classes = Model(lanes, _classes(names)), _classes(names)
    wide = classes - 1 > _WIDE
    #: Class k of each rank x: the bits of x + 1, less one.
    kind = np.repeat(np.arange(classes, dtype=np.int8), 1 << np.arange(classes))[:names]
    low, size = np.zeros(lanes, np.int64), np.full(lanes, 1 << 62)
    # The first word only takes up a carry, which there is none of.
    room = n + 64
    out = np.zeros(lanes * room, np.uint32)
    at = np.arange(lanes) * room
    top = at + room - 80

    def widened() -> None:
        nonlocal low, size, at
        due = size - _SMALL >> 63
        out[at] = (low >> 46).astype(np.uint32)
        shift = due & 16
        low = (low & (~due | _MASK)) << shift
        size = size << shift
        at = at - due
        if size.min() >= _SMALL:
            return
        more = np.flatnonzero(size < _SMALL)
        while len(more):
            rest = low[more]
            out[at[more]] = rest >> 46
            low[more] = (rest & _MASK) << 16
            size[more] <<= 16
            at[more] += 1
            more = more[size[more] < _SMALL]

    past = np.zeros((2, lanes), np.int64)
    for start in range(0, n, 16):
        if (at >= top).any():  # ids that cost more than a word each
            grown = np.zeros(lanes * room * 2, np.uint32)
            grown.reshape(lanes, -1)[:, :room] = out.reshape(lanes, -1)
            at = at + model.lane * room
            out, room = grown, room * 2
            top = model.lane * room + room - 80
        some = np.ascontiguousarray(ranks[:, start : start + 16].T).astype(np.int64)
        kinds = kind[some].astype(np.int64)
        past = np.concatenate([past[-2:], some])
        at1, at2 = model.places(past[1:-1], past[:-2])
        for i, (plain, k, o, of) in enumerate(zip(some << 4, kinds, some + 1 - (1 << kinds), kinds * lanes + model.lane, strict=True)):
            model.look(at1[i], at2[i])
            hit2, hit1 = (model.e2 ^ plain) - 16 >> 63, (model.e1 ^ plain) - 16 >> 63
            s2 = (size >> _BITS) * model.w2
            rest = size - s2
            s1 = (rest >> _BITS) * model.m1
            part = rest - s1 >> _BITS
            own = part * model.width[of]
            begin = part * model.first[of] + s1
            if not wide:
                own >>= k
                begin += own * o
            missed = ~hit2
            named = hit1 & missed
            neither = missed ^ named
            size = s2 & hit2 | s1 & named | own & neither
            low = low + (s2 & missed) + (begin & neither)
            widened()
            if wide:
                own = size >> (k & neither)
                low = low + (own * o & neither)
                size = own
                widened()
            model.learn(plain, k, hit2, hit1)
    for _ in range(4):
        out[at] = low >> 46
        low = (low & _MASK) << 16
        at = at + 1
    used = at - model.lane * room
    while len(over := np.flatnonzero(out >> 16)):
        out[over] &= 0xFFFF
        out[over - 1] += 1
    words = out.astype(np.uint16).reshape(lanes, room)
    return [words[i, : used[i]] for i in range(lanes)]


def decode_blocks(words: list[np.ndarray], n: int, names: int) -> np.ndarray:
    """The ranks (lanes, n) that encode_blocks was given; what is damaged comes out as any ranks."""
    lanes = len(words)
    model, classes = Model(lanes, _classes(names)), _classes(names)
    wide = classes - 1 > _WIDE
    longest = max(map(len, words)) + 8
    given = np.zeros((lanes, longest + 1), np.uint16)
    for i, w in enumerate(words):
        given[i, : len(w)] = w
    ahead, size = np.zeros(lanes, np.int64), np.full(lanes, 1 << 62)
    # 62 bits are looked at: three words and 14 bits of the next; from there on in steps of 16.
    for i in range(3):
        ahead = (ahead << 16) | given[:, i]
    ahead = (ahead << 14) | (given[:, 3] >> 2)
    given = ((given[:, :-1] & 3) << 14 | given[:, 1:] >> 2).ravel()
    at = model.lane * longest
    last = at + longest - 1
    at = at + 3

    def widened() -> None:
        nonlocal ahead, size, at
        due = size - _SMALL >> 63
        shift = due & 16
        ahead = ahead << shift | given[np.minimum(at, last)].astype(np.int64) & due
        size = size << shift
        at = at - due
        if size.min() >= _SMALL:
            return
        more = np.flatnonzero(size < _SMALL)
        while len(more):
            ahead[more] = (ahead[more] << 16) | given[np.minimum(at[more], last[more])]
            size[more] <<= 16
            at[more] += 1
            more = more[size[more] < _SMALL]

    def quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.view(U) // b.view(U)).view(np.int64)

    out = np.zeros((n, lanes), np.int32 if classes < 31 else np.int64)
    under = np.empty((classes - 1, lanes), bool)
    x = y = np.zeros(lanes, np.int64)
    for i in range(n):
        model.look(*model.places(x, y))
        s2 = (size >> _BITS) * model.w2
        rest = size - s2
        s1 = (rest >> _BITS) * model.m1
        part = rest - s1 >> _BITS
        after = ahead - s2
        hit2 = after >> 63
        beyond = after - s1
        by_name = beyond >> 63
        neither, named = ~by_name, by_name & ~hit2
        v = np.minimum(quotient(beyond & neither, part), _ONE - 1).astype(np.int16)
        # Edges up to v are counted.
        np.less_equal(model.inner, v, out=under)
        k = under.view(np.int8).sum(axis=0, dtype=np.int8).astype(np.int64)
        of = k * lanes + model.lane
        own = part * model.width[of]
        beyond = beyond - part * model.first[of] & neither
        base = (1 << k) - 1
        if not wide:
            own >>= k
            o = np.minimum(quotient(beyond, own), base)
            beyond -= o * own
        ahead = ahead & hit2 | after & named | beyond
        size = s2 & hit2 | s1 & named | own & neither
        widened()
        if wide:
            own = size >> (k & neither)
            o = np.minimum(quotient(ahead & neither, own), base)
            ahead = ahead - o * own
            size = own
            widened()
        x, y = model.e2 >> 4 & hit2 | model.e1 >> 4 & named | base + o & neither, x
        out[i] = x
        plain = x << 4
        model.learn(plain, k, hit2, (model.e1 ^ plain) - 16 >> 63)
    return np.ascontiguousarray(out.T)


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], block: int | None = None) -> bytes:
    """One segment's bytes. Blocks are smaller where the segment has few ids, for the sake of lanes."""
    lens = np.array([len(i) for i in ids], "<u4")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    block = block or min(BLOCK, max(LEAST, len(flat) // LANES))
    if len(flat) and flat.max() < 1 << 20:
        seen = np.bincount(flat)
        names = np.lexsort((np.arange(len(seen)), -seen))[: int((seen > 0).sum())]
        rank = np.zeros(len(seen), np.int32)
        rank[names] = np.arange(len(names), dtype=np.int32)
        of = rank[flat]
    else:
        names, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((names, -seen))
        rank = np.zeros(len(names), np.int32)
        rank[order] = np.arange(len(names), dtype=np.int32)
        names, of = names[order], rank[at]
    blocks = -(-len(flat) // block)
    ranks = np.zeros(blocks * block, np.int32)
    ranks[: len(flat)] = of
    width = min(block, len(flat))
    words = encode_blocks(ranks.reshape(blocks, block)[:, :width], len(names)) if blocks else []
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    table = zlib.compress(nulls.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lens.tobytes())
    named = zlib.compress(names.astype("<u4").tobytes())
    head = struct.pack(HEAD, MAGIC, VERSION, block, len(ids), len(flat), blocks, len(table), len(named)) + table + named
    raw = flat.astype("<u4", copy=False)
    marks = [
        struct.pack("<III", len(w), len(part), zlib.crc32(part.tobytes()))
        for i, w in enumerate(words)
        for part in [raw[i * block : (i + 1) * block]]
    ]
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *marks, *(w.astype("<u2").tobytes() for w in words)])


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """doc_ids, ids per document, all ids, and the ranges of ids that lie in damaged blocks.

    A damaged head or table leaves nothing to be read: DamagedBlock.
    """
    size = struct.calcsize(HEAD)
    if len(data) < size + 4 or data[:4] != MAGIC:
        raise DamagedBlock("this is no segment")
    _, version, block, docs, n, blocks, t, m = struct.unpack_from(HEAD, data)
    at = size + t + m
    if version != VERSION or len(data) < at + 4 or struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
        raise DamagedBlock("the segment's head is damaged")
    table = zlib.decompress(data[size : size + t])
    names = np.frombuffer(zlib.decompress(data[size + t : at]), "<u4")
    nulls = np.frombuffer(table, np.uint8, docs)
    doc_ids = np.frombuffer(table, "<i8", docs, docs)
    lens = np.frombuffer(table, "<u4", docs, docs * 9)
    marks = np.frombuffer(data[at + 4 : at + 4 + blocks * 12].ljust(blocks * 12, b"\0"), "<u4").reshape(blocks, 3)
    at += 4 + blocks * 12
    # What follows a mark that is damaged, or is cut off, is read as it comes and fails its own check.
    words = []
    for w in marks[:, 0].tolist():
        words.append(np.frombuffer(data[at : at + 2 * w][: max(0, len(data) - at) // 2 * 2], "<u2"))
        at += w * 2
    ids = np.zeros(0, "<u4")
    if blocks:
        ranks = decode_blocks(words, min(block, n), len(names)).reshape(-1)[:n]
        ids = names[np.clip(ranks, 0, len(names) - 1)].astype("<u4")
    bad = [
        (i * block, min(n, (i + 1) * block))
        for i in range(blocks)
        if zlib.crc32(ids[i * block : (i + 1) * block].tobytes()) != marks[i, 2]
    ]
    return [None if z else int(d) for z, d in zip(nulls, doc_ids, strict=True)], lens, ids, bad


def written(docs: DataFrame, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode documents in ascending order of doc_id; segments as stored in the shared folder.

    (part, segment, n_ids, data): parts follow the order of doc_id, segments the
    order within a part. Nulls sort first; equal doc_ids follow a hash of their
    texts, by which they are also dealt out, so that one doc_id may span parts.
    A null or empty text has the end id only. Texts of any length are whole; a
    segment has from SEGMENT to twice as many ids, unless there are fewer or one
    document has more. An empty table gives no segments. Columns besides doc_id and text aren't looked at.
    """
    from pyspark import TaskContext

    named = path

    def run(batches):
        import pyarrow as pa

        t = transducer(named or tokenizer_path(), MEMO)
        part, segment = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ids: list = []
        held = 0

        def closed(n: int):
            """A segment of the first n documents held; coding is quicker the more blocks there are."""
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([sum(map(len, ids[:n]))], pa.int64()), pa.array([pack_segment(doc_ids[:n], ids[:n])], pa.binary())],
                names=["part", "segment", "n_ids", "data"],
            )

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                found: list[list[np.ndarray]] = [[] for _ in range(rows.num_rows)]
                for i, some in t.coded(rows.column(1).to_pylist()):
                    found[i].append(some)
                for doc_id, parts in zip(rows.column(0).to_pylist(), found, strict=True):
                    own = np.concatenate([*parts, [END_ID]]).astype(np.uint32)
                    doc_ids.append(doc_id)
                    ids.append(own)
                    held += len(own)
                    if held >= 2 * SEGMENT:  # the first half goes, so that the last segment isn't small
                        n = int(np.searchsorted(np.cumsum([len(x) for x in ids]), SEGMENT)) + 1
                        yield closed(n)
                        held -= sum(map(len, ids[:n]))
                        doc_ids, ids, segment = doc_ids[n:], ids[n:], segment + 1
        if ids:
            yield closed(len(ids))

    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    dealt = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    segments = mapped(dealt.select("doc_id", "text"), run, "part int, segment int, n_ids long, data binary")
    return stage(segments, "token-segments")


def read_back(segments: DataFrame, as_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document in the segments.

    A document that lies in a damaged block, in whole or part, has nulls for its
    ids and their CRC; all others are whole. A damaged head stops the reading.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, segment, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                doc_ids, lens, ids, bad = unpack_segment(data.as_py())
                ends = np.cumsum(lens, dtype=np.int64)
                starts = ends - lens
                damaged = np.zeros(len(lens), bool)
                for a, b in bad:
                    damaged |= (starts < b) & (ends > a)
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                n = len(doc_ids)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array([part.as_py()] * n, pa.int32()),
                    pa.array([segment.as_py()] * n, pa.int32()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(starts),
                    pa.array(lens.astype(np.int64)),
                    pa.array(crc, pa.int64(), mask=damaged),
                ]
                names = ["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if as_ids:
                    columns.append(pa.array([None if d else ids[a:b].astype(np.int32) for d, a, b in zip(damaged, starts, ends, strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids array<int>" if as_ids else "")
    found = mapped(segments.select("part", "segment", "data"), run, schema)
    sizes = segments.select("part", "segment", "n_ids")
    # One row for each part, as many as there are partitions; then each part's segments.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    starts = sizes.withColumn("inside", inside).join(parts, "part")
    starts = starts.select("part", "segment", (F.col("before") + F.col("inside")).alias("first"))
    return found.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if as_ids else [])
    )
