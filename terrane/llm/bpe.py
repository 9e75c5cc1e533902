"""BPE as a bounded-lookahead streaming transducer, and its decoder.

How far to the right a merge can be disturbed follows from the merge list alone
(sufficient_lookahead). A long run of letters is therefore encoded in windows:
tokens that end before the window's last `lookahead` symbols are stable and are
emitted, and the rest waits for more input, so memory stays constant however long
the run. A run shorter than a window is one window: runs are found in the bytes of
some texts at once, the short ones that aren't known yet are merged together, all
of one length in lockstep, and kept in a memo of bounded size.

The file names its normaliser, pre-tokeniser, byte alphabet and special tokens.
One family of files is understood (NFC, white space, lower case; a split by
pattern; words with an end suffix; no decoder); any other is refused.

Decoding has two incremental forms over the ids. One joins the tokens by blanks,
as a file that names no decoder asks for. The other is a byte-to-text state
machine, whose state is the bytes of a character that isn't complete.

Null and empty texts have no ids. Texts of any length are read in pieces; equal
texts and equal doc_ids are each answered for themselves; an empty table gives an
empty result; columns besides doc_id and text are never looked at.
"""

from __future__ import annotations

import codecs
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

#: Entries of the memo of short runs, if no other number is asked for; it is emptied when full.
MEMO = 1 << 18
#: Symbols of a run that are encoded at once, besides the lookahead.
WINDOW = 1024
#: Runs of fewer bytes than this are one window; of at most PACKED, a key of two longs.
SHORT = 64
PACKED = 15
#: Code points of a text that are normalised at once, and of texts that are encoded together.
PIECE = 1 << 16
TOGETHER = 1 << 20
#: Rows whose texts are turned into Python strings at once.
ROWS = 1024
#: Fixed by the format: the suffix of a word's last token, and the pattern of its runs.
END = "</w>"
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of characters in RUNS.
BLANK, LETTER, NUMBER, OTHER = range(4)

U = np.uint64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    out, other = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + other))
        other += b not in plain
    return out


def sufficient_lookahead(merges: list[tuple[str, str]], size=len) -> int:
    """Symbols right of a token that can decide whether its last merge happens.

    A merge (x, y) fails if y, or a token on y's right edge, is first taken by an
    earlier merge with what follows; that one may fail likewise to a still earlier
    merge, and so on. Ranks fall along such a chain, so that one pass in rank
    order bounds the longest: need(x, y) = |y| + the most that any earlier merge
    whose left part lies on y's right edge needs.
    """
    right: dict[str, str] = {}
    best: dict[str, int] = {}
    most = 0
    for x, y in merges:
        reach, t = 0, y
        while t is not None:
            reach = max(reach, best.get(t, 0))
            t = right.get(t)
        need = size(y) + reach
        best[x] = max(best.get(x, 0), need)
        right.setdefault(x + y, y)
        most = max(most, need)
    return most


class Pairs:
    """Rank and product of each merge by the ids of its two sides: a table with open addressing."""

    BITS = 18
    NONE = 1 << 30

    def __init__(self, left: np.ndarray, right: np.ndarray, product: np.ndarray) -> None:
        while len(left) > 1 << (self.BITS - 2):
            self.BITS += 1
        self.product = product.astype(np.int32)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, self.NONE, np.int32)
        key, rank = self.key(left, right), np.arange(len(left), dtype=np.int32)
        at = self.place(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]] = key[put], rank[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, at = key[rest], rank[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 24) | right

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for those that never merge."""
        key = self.key(left, right)
        at = self.place(key)
        there = self.keys[at]
        out = np.where(there == key, self.ranks[at], np.int32(self.NONE))
        more = np.flatnonzero((there != key) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            there = self.keys[at[more]]
            hit = there == key[more]
            out[more[hit]] = self.ranks[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out

    def merged(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Greedy BPE of each row of s, all rows one merge at a time: (rows that are done, their ids)."""
        row = np.arange(len(s))
        if s.shape[1] < 2:
            yield row, s
            return
        ranks = self.rank(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(s), -1)
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(s)), at]
            live = least < self.NONE
            if not live.all():
                yield row[~live], s[~live]
                row, s, ranks, at, least = row[live], s[live], ranks[live], at[live], least[live]
            if not len(s):
                return
            n, each = s.shape[1] - 1, np.arange(len(s))
            new = self.product[least]
            if n == 1:
                yield row, new[:, None]
                return
            # Beyond the merged pair all move one to the left.
            s = np.where(np.arange(n) > at[:, None], s[:, 1:], s[:, :-1])
            s[each, at] = new
            ranks = np.where(np.arange(n - 1) >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 1)
            r, c = np.concatenate([left, right]), np.concatenate([at[left] - 1, at[right]])
            ranks[r, c] = self.rank(s[r, c], s[r, c + 1])


class Known:
    """Ids of short runs by their bytes, exactly: open addressing; emptied when it holds more than a limit."""

    def __init__(self) -> None:
        self.most = 0
        self.limit(MEMO)

    def limit(self, most: int) -> None:
        if most != self.most:
            self.most, self.bits = most, most.bit_length()
            self.empty()

    def empty(self) -> None:
        self.a = np.zeros(1 << self.bits, U)
        self.b = np.zeros(1 << self.bits, U)
        #: Place of the ids in the store, times 256, plus their number; a run has at least one id.
        self.at = np.zeros(1 << self.bits, np.int64)
        self.store = np.zeros(1 << 16, np.int32)
        self.used = self.entries = 0

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (b * U(0xBF58476D1CE4E5B9))) * U(0x9E3779B97F4A7C15)
        return ((h ^ (h >> U(29))) * U(0x94D049BB133111EB) >> U(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the ids of each run are; 0 for those not known."""
        place = self.place(a, b)
        at = self.at[place]
        more = np.flatnonzero((at > 0) & ((self.a[place] != a) | (self.b[place] != b)))
        while len(more):
            place[more] = p = (place[more] + 1) & (len(self.at) - 1)
            at[more] = x = self.at[p]
            more = more[(x > 0) & ((self.a[p] != a[more]) | (self.b[p] != b[more]))]
        return at

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Different new runs, n ids of each."""
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(ids)] = ids
        at = ((self.used + np.cumsum(n) - n) << 8) | n
        self.used += len(ids)
        self.entries += len(n)
        place, rest = self.place(a, b), np.arange(len(n))
        while len(rest):
            free = np.flatnonzero(self.at[place[rest]] == 0)
            _, first = np.unique(place[rest[free]], return_index=True)
            put = free[first]
            i = rest[put]
            p = place[i]
            self.a[p], self.b[p], self.at[p] = a[i], b[i], at[i]
            rest = np.delete(rest, put)
            place[rest] = (place[rest] + 1) & (len(self.at) - 1)


def refused(spec: dict) -> str | None:
    """Why a tokenizer file isn't of the family that this module understands, if so."""
    model = spec["model"]
    plain = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    if (spec.get("normalizer") or {}).get("normalizers") != plain:
        return "its normaliser isn't NFC, white space to one blank, lower case"
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [p["type"] for p in steps] != ["Split", "ByteLevel"]:
        return "its pre-tokeniser isn't a split and a byte alphabet"
    if steps[0]["pattern"] != {"Regex": RUNS}:
        return "its split has another pattern"
    if steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["add_prefix_space"] or steps[1].get("use_regex", True):
        return "its split keeps other parts than those that match"
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
        return f"its model isn't BPE with {END}"
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk")):
        return "its model has options that aren't known here"
    if spec.get("decoder") or spec.get("post_processor"):
        return "it names a decoder or a post-processor"
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return "its special tokens look at what surrounds them"
    return None


class Transducer:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if why := refused(spec):
            raise ValueError(f"{path}: {why}")
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_ids = frozenset(self.special.values())
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((NUMBER, r"\p{N}+"), (LETTER, r"\p{L}+"), (BLANK, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
                self.kind[a:b] = kind
        self.alphabet = byte_alphabet()
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(END)))
        self.token = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.token[i] = t
        get = self.ids.__getitem__
        self.pairs = Pairs(
            np.array([get(a) for a, _ in merges]), np.array([get(b) for _, b in merges]), np.array([get(a + b) for a, b in merges])
        )
        self.inner = np.array([get(c) for c in self.alphabet], np.int32)
        self.last = np.array([get(c + END) for c in self.alphabet], np.int32)
        self.known = Known()
        self._bytes: list[bytes] = []

    def normalised(self, text: str) -> str:
        """Each character as the file's normaliser leaves it; white space, which only parts runs, stays."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # A final sigma is lowered like any other: each character for itself.
            return text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return text.lower()

    def merged(self, symbols: list[str]) -> list[str]:
        """Greedy BPE of one window: the lowest rank first, leftmost first."""
        rank, worst = self.rank, len(self.rank)
        ranks = [rank.get(p, worst) for p in zip(symbols, symbols[1:])]  # noqa: B905
        while ranks and len(ranks) < 48:
            least = min(ranks)
            if least == worst:
                return symbols
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((symbols[i - 1], symbols[i]), worst)
            if i < len(ranks):
                ranks[i] = rank.get((symbols[i], symbols[i + 1]), worst)
        while ranks:  # in a long window all places of a merge at once
            least = min(ranks)
            if least == worst:
                break
            a, b = symbols[at := ranks.index(least)], symbols[at + 1]
            out, i, n = symbols[:at], at, len(symbols)
            while i < n:
                if i + 1 < n and symbols[i] == a and symbols[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
            ranks = [rank.get(p, worst) for p in zip(symbols, symbols[1:])]  # noqa: B905
        return symbols

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Ids of one run of symbols, each as soon as nothing later can change it."""
        held: list[str] = []
        ids, look = self.ids, self.lookahead
        most = WINDOW + look
        for s in symbols:
            held.append(s)
            if len(held) >= 2 * most:
                done = 0
                for t in self.merged(held):
                    if done + len(t) > len(held) - look:
                        break
                    yield ids[t]
                    done += len(t)
                del held[:done]
        yield from (ids[t] for t in self.merged(held))

    def symbols(self, run: bytes) -> Iterator[str]:
        """Byte symbols of a run, the last with the end-of-word suffix."""
        alphabet = self.alphabet
        for b in run[:-1]:
            yield alphabet[b]
        yield alphabet[run[-1]] + END

    def one_run(self, run: bytes) -> list[int]:
        if len(run) >= SHORT:
            return list(self.stream(self.symbols(run)))
        return list(map(self.ids.__getitem__, self.merged(list(self.symbols(run)))))

    def kinds(self, raw: np.ndarray) -> np.ndarray:
        """The class of the character that each byte of valid UTF-8 is part of."""
        out = self.kind[:128][raw & 127]
        at = np.flatnonzero(raw >= 0xC0)
        if len(at):
            lead = raw[at].astype(np.int32)
            more = 1 + (lead >= 0xE0) + (lead >= 0xF0)
            point = lead & (0x3F >> more)
            for k in (1, 2, 3):
                has = more >= k
                point[has] = (point[has] << 6) | (raw[at[has] + k] & 63)
            kind = self.kind[point]
            for k in (0, 1, 2, 3):
                has = more >= k
                out[at[has] + k] = kind[has]
        return out

    def found_runs(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each run in normalised UTF-8: what RUNS matches, in order."""
        kind = self.kinds(raw)
        new = np.empty(len(raw) + 1, bool)
        new[0] = new[-1] = True
        new[1:-1] = kind[1:] != kind[:-1]
        new[:-1] |= (kind == NUMBER) & ((raw & 0xC0) != 0x80)
        at = np.flatnonzero(new)
        start, end = at[:-1], at[1:]
        some = kind[start] != BLANK
        start, end = start[some].copy(), end[some].copy()
        # An apostrophe alone takes s, t, m, d, re, ve or ll from the letters after it.
        mark = np.flatnonzero((raw[start] == 39) & (end - start == 1))
        mark = mark[mark + 1 < len(start)]
        mark = mark[(start[mark + 1] == end[mark]) & (kind[np.minimum(end[mark], len(raw) - 1)] == LETTER)]
        if len(mark):
            one = raw[end[mark]]
            two = np.where(end[mark + 1] - end[mark] > 1, raw[np.minimum(end[mark] + 1, len(raw) - 1)], 0)
            taken = np.where(np.isin(one, list(b"stmd")), 1, 0)
            taken = np.where(((one == 108) & (two == 108)) | (np.isin(one, list(b"rv")) & (two == 101)), 2, taken)
            end[mark] += taken
            start[mark + 1] += taken
            some = start < end
            start, end = start[some], end[some]
        return start, end

    def run_ids(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the runs of normalised UTF-8, ids of each, their ids)."""
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.int32)
        start, end = self.found_runs(raw)
        size = end - start
        short = size <= PACKED
        longs = np.frombuffer(data + bytes(24 - len(data) % 8), "<u8")
        s, n = start[short], size[short]
        word, off = s >> 3, ((s & 7) << 3).astype(U)
        one, two, three = longs[word], longs[word + 1], longs[word + 2]
        up = (U(64) - off) & U(63)
        whole = off == 0
        a = np.where(whole, one, (one >> off) | (two << up))
        b = np.where(whole, two, (two >> off) | (three << up))
        a &= ~U(0) >> (U(8) * U(8) - U(8) * np.minimum(n, 8).astype(U))
        rest = np.maximum(n - 8, 0).astype(U)
        b &= (U(1) << (U(8) * rest)) - U(1)
        b |= n.astype(U) << U(56)
        known = self.known
        if known.entries > known.most:
            known.empty()
        at = known.find(a, b)
        new = np.flatnonzero(at == 0)
        if len(new):
            order = new[np.lexsort((b[new], a[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            lone = order[first]
            counts, ids = self.merged_runs(raw, s[lone], n[lone])
            # The memo takes what a call brings, however much that is; it is emptied before the next.
            while known.entries + len(lone) > 3 << (known.bits - 2):
                known.bits += 1
                known.empty()
                return self.run_ids(data)
            known.add(a[lone], b[lone], counts, ids)
            at[new] = known.find(a[new], b[new])
        n_ids, first = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        n_ids[short], first[short] = at & 255, at >> 8
        store, rare = known.store[: known.used], np.flatnonzero(~short)
        if len(rare):
            own: dict[bytes, list[int]] = {}
            extra: list[int] = []
            place = []
            for i in rare.tolist():
                run = data[start[i] : end[i]]
                ids = own.get(run)
                if ids is None:
                    ids = self.one_run(run)
                    if len(run) < SHORT:
                        own[run] = ids
                place.append((len(extra), len(ids)))
                extra += ids
            first[rare] = np.array(place)[:, 0] + len(store)
            n_ids[rare] = np.array(place)[:, 1]
            store = np.concatenate([store, np.array(extra, np.int32)])
        upto = np.cumsum(n_ids)
        return start, n_ids, store[np.repeat(first - upto + n_ids, n_ids) + np.arange(upto[-1] if len(upto) else 0)]

    def merged_runs(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each short run, and the ids: runs of one length are merged in lockstep."""
        counts = np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            bytes_ = raw[start[rows][:, None] + np.arange(n)]
            s = self.inner[bytes_]
            s[:, -1] = self.last[bytes_[:, -1]]
            for done, ids in self.pairs.merged(s):
                counts[rows[done]] = ids.shape[1]
                found.append((rows[done], ids))
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in found:
            out[first[rows][:, None] + np.arange(ids.shape[1])] = ids
        return counts, out

    def pieces(self, text: str) -> Iterator[str]:
        """A text in parts that end before a blank, where no rule looks across."""
        at = 0
        while len(text) - at > PIECE:
            end = text.find(" ", at + PIECE)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def parts(self, text: str) -> Iterator[str]:
        """Pieces of a text; special tokens are parts of their own."""
        whole = [text]
        if self.cut and any(s in text for s in self.special):
            whole = self.cut.split(text)
        for part in whole:
            if part in self.special:
                yield part
            else:
                yield from self.pieces(part)

    def coded(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(position of the text, ids of its next part), in the order of texts and parts."""
        held: list[tuple[int, bytes | int]] = []
        size = 0

        def out():
            start, n, ids = self.run_ids(b"\n".join(b"" if isinstance(x, int) else x for _, x in held))
            ends = np.concatenate(([0], np.cumsum(n)))
            bounds = np.cumsum([0 if isinstance(x, int) else len(x) for _, x in held]) + np.arange(len(held))
            cuts = ends[np.searchsorted(start, bounds)].tolist()
            for (i, x), a, b in zip(held, [0, *cuts], cuts, strict=False):
                yield i, np.array([x], np.int32) if isinstance(x, int) else ids[a:b]

        for i, text in enumerate(texts):
            for part in self.parts(text or ""):
                held.append((i, self.special[part] if part in self.special else self.normalised(part).encode()))
                size += len(part)
                if size >= TOGETHER:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(ids.tolist() for _, ids in self.coded([text])))

    @property
    def bytes(self) -> list[bytes]:
        """The bytes of each token; an end of word is a blank, a special token its own text."""
        if not self._bytes:
            of = {c: b for b, c in enumerate(self.alphabet)}
            for i, t in enumerate(self.token):
                if i in self.special_ids:
                    self._bytes.append(t.encode())
                else:
                    ends = t.endswith(END) and t != END
                    self._bytes.append(bytes(of[c] for c in (t.removesuffix(END) if ends else t)) + b" " * ends)
        return self._bytes

    def joined(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """What a file that names no decoder gives: the tokens, joined by blanks."""
        between = ""
        for ids in parts:
            if ids:
                yield between + " ".join(map(self.token.__getitem__, ids))
                between = " "

    def decode(self, ids: Iterable[int]) -> str:
        """Readable text of ids."""
        state = Readable(self)
        return state.feed(list(ids)) + state.end()


class Readable:
    """Byte-to-text state machine: gives text as soon as its bytes form whole characters.

    State: the bytes of an unfinished character; bytes that form none become the
    replacement character. A special token ends what is unfinished.
    """

    def __init__(self, t: Transducer) -> None:
        self.t, self.state = t, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        t = self.t
        if t.special_ids.isdisjoint(ids):
            return self.state.decode(b"".join(map(t.bytes.__getitem__, ids)))
        out = []
        for i in ids:
            if i in t.special_ids:
                out += [self.end(), t.token[i]]
            else:
                out.append(self.state.decode(t.bytes[i]))
        return "".join(out)

    def end(self) -> str:
        tail = self.state.decode(b"", True)
        self.state.reset()
        return tail


def transducer(path: str, memo: int = MEMO) -> Transducer:
    """The transducer of a file, one for each Python process; its memo has the size that was asked for last."""
    kept = sys.__dict__.setdefault("_terrane_transducers", {})
    if path not in kept:
        kept[path] = Transducer(path)
    kept[path].known.limit(memo)
    return kept[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs, path: str | None = None, as_ids: bool = False):
    """doc_id and the ids of each whole text, or their digests.

    A null or empty text has no ids. Rows keep to themselves: no shuffle, and
    repeated rows or doc_ids are answered each for itself. With as_ids the column
    ids holds the ids and decoded the readable text; without, n_tokens and the
    SHA-256 of the decimal ids, of the joined tokens and of the readable text,
    each fed part by part as the transducer emits them.
    """
    from pyspark.sql import functions as F

    from terrane.llm.common import mapped

    named = path

    def digests(t, texts):
        import hashlib

        number = list(map(str, range(len(t.token))))
        rows = len(texts)
        n = [0] * rows
        sums = [[hashlib.sha256() for _ in range(rows)] for _ in range(3)]
        at, state = -1, Readable(t)
        for i, part in t.coded(texts):
            if i != at and at >= 0:
                sums[2][at].update(state.end().encode())
            at, ids = i, part.tolist()
            if ids:
                between = " " if n[i] else ""
                sums[0][i].update((between + " ".join(map(number.__getitem__, ids))).encode())
                sums[1][i].update((between + " ".join(map(t.token.__getitem__, ids))).encode())
                sums[2][i].update(state.feed(ids).encode())
                n[i] += len(ids)
        if at >= 0:
            sums[2][at].update(state.end().encode())
        return n, *([s.hexdigest() for s in column] for column in sums)

    def whole(t, texts):
        ids: list[list[int]] = [[] for _ in texts]
        for i, part in t.coded(texts):
            ids[i] += part.tolist()
        return list(map(len, ids)), ids, [t.decode(x) for x in ids]

    names = ["ids", "decoded"] if as_ids else ["ids_sha256", "decoded_sha256", "readable_sha256"]
    kinds = ["array<int>", "string"] if as_ids else ["string"] * 3
    schema = ", ".join(f"{a} {b}" for a, b in zip(["doc_id", "n_tokens", *names], ["long", "long", *kinds], strict=True))

    def run(batches):
        import pyarrow as pa

        t = transducer(named or tokenizer_path())
        types = [pa.int64(), *((pa.list_(pa.int32()), pa.string()) if as_ids else [pa.string()] * 3)]
        for batch in batches:
            for first in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(first, ROWS)
                found = (whole if as_ids else digests)(t, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, k) for x, k in zip(found, types, strict=True))], names=["doc_id", "n_tokens", *names]
                )

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
