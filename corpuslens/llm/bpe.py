"""Byte-level BPE over whole columns: vectorised pre-tokenisation, then cached pair merging.

Pre-tokenisation finds the boundaries of the pattern of byte-level BPE without a regex. Each code point gets a
symbol from its class and its neighbours (so look-ahead is in the symbol). A symbol is a function from states
to states; such functions compose associatively, and only a few hundred different ones arise, so a blocked
prefix scan over the numbers of composed functions, by table, gives the state before every code point at once.

Pair merging works on all unknown pre-tokens of a slice together: in each round, every pre-token merges its
best pair, leftmost first. Results go to a cache of bounded size per Python worker.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from corpuslens.llm.arrays import SPACE as WHITE_BYTE
from corpuslens.llm.arrays import eights, mix

#: Bytes of text worked on at once; a longer text goes in parts.
SLICE_BYTES = 1 << 20
#: A worker's cache has 2**CACHE_BITS slots (24 bytes each); it takes in no more once half full, and the next slice begins an
#: empty one. Longer pre-tokens than CACHED_BYTES aren't kept, and longer ones than MERGED_BYTES are merged one at a time.
CACHE_BITS, CACHED_BYTES, MERGED_BYTES = 20, 16, 64
#: Pre-tokens merged together.
MERGED_TOGETHER = 1 << 16
#: A longer pre-token is merged in runs of about APART bytes that no token joins; a run of more than HEAPED_BYTES in rounds.
APART, HEAPED_BYTES = 32, 1 << 14
#: Where no pre-token surely starts in so many bytes, a long text is parted inside a pre-token.
NEAR_BYTES = 1 << 16

# ---- pre-tokenisation

OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
#: Symbols: the classes without SPACE and BLANK, then white space by what follows, then apostrophes that
#: contract with one or two letters. FIRST is added at the start of a text.
S_GLUE, S_ALONE, S_RUN, S_SHORT, S_LONG, FIRST = 3, 4, 5, 6, 7, 8
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, GLUED, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)
#: Letters and numbers that Unicode 16.0 has and 15.1, which Python knows, has not.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        table[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for a, b in ranges:
            table[a : b + 1] = kind
    table[WHITE] = BLANK
    table[0x20] = SPACE
    return table


def step(state: int, symbol: int) -> tuple[int, bool]:
    """State after a symbol, and if a pre-token starts at it."""
    if symbol >= FIRST:
        state, symbol, first = FRESH, symbol - FIRST, True
    else:
        first = False
    if state == TWO_LEFT:
        return ONE_LEFT, first
    if state == ONE_LEFT:
        return FRESH, first
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, S_RUN: IN_BLANKS}.get(symbol, IN_OTHERS)
    if symbol == S_GLUE:
        return GLUED, True
    if symbol == S_ALONE:
        return FRESH, True
    if symbol in (S_SHORT, S_LONG) and state not in (IN_OTHERS, GLUED):
        return (ONE_LEFT if symbol == S_SHORT else TWO_LEFT), True
    return run, first or state not in (run, GLUED)


@lru_cache(1)
def functions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol's function, table of compositions, table of results, table of starts."""
    made = {tuple(range(8)): 0}
    of_symbol = [made.setdefault(tuple(step(s, x)[0] for s in range(8)), len(made)) for x in range(16)]
    todo = list(made)
    while todo:
        f = todo.pop()
        for x in range(16):
            g = tuple(step(s, x)[0] for s in f)
            if g not in made:
                made[g] = len(made)
                todo.append(g)
    listed = list(made)
    compose = np.array([[made[tuple(g[s] for s in f)] for g in listed] for f in listed], np.uint16)
    starts = np.array([[step(s, x)[1] for x in range(16)] for s in range(8)])
    return np.array(of_symbol, np.uint16), compose, np.array(listed, np.uint8), starts


def scan(x: np.ndarray, compose: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix compositions of the functions numbered in x."""
    n = len(x)
    if n <= block:
        out = x.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], x[i]]
        return out
    rows = -(-n // block)
    padded = np.zeros(rows * block, x.dtype)  # 0 is the identity
    padded[:n] = x
    columns = np.ascontiguousarray(padded.reshape(rows, block).T)
    flat, m = compose.ravel(), len(compose)
    for j in range(1, block):
        columns[j] = flat[columns[j - 1].astype(np.int32) * m + columns[j]]
    before = np.zeros(rows, x.dtype)
    before[1:] = scan(columns[-1], compose, block)[:-1]
    return flat[before.astype(np.int32)[:, None] * m + columns.T].ravel()[:n]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens start. Every text that isn't empty starts one."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.int64)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width) - width
    first = np.zeros(len(points) + 1, bool)
    first[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
    first[-1] = True
    kind = classes()[points]
    white = kind >= SPACE
    solid_next = np.zeros(len(points), bool)
    solid_next[:-1] = ~white[1:]
    solid_next &= ~first[1:]
    symbol = np.where(white, np.where(solid_next, np.where(kind == SPACE, S_GLUE, S_ALONE), S_RUN), kind).astype(np.uint8)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        after = np.pad(points, (0, 2))
        one = np.where(first[quote + 1], 0, after[quote + 1])
        two = np.where(first[np.minimum(quote + 2, len(points))], 0, after[quote + 2])
        symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        long = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        symbol[quote[long]] = S_LONG
    symbol[first[:-1]] += FIRST
    of_symbol, compose, result, starts = functions()
    total = scan(of_symbol[symbol], compose)
    state = np.empty(len(points), np.uint8)
    state[0] = FRESH
    state[1:] = result[total[:-1], FRESH]
    return at[starts[state, symbol]]


# ---- merging


class Vocabulary:
    """Tokens and the pairs that merge. ``rank`` orders merges; ``made`` is what a pair becomes."""

    def __init__(self, tokens: list[bytes], bytes_to_id: np.ndarray, pairs: np.ndarray, order: np.ndarray, made: np.ndarray, special: dict[bytes, int]):
        self.size = len(tokens)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = bytes_to_id
        sort = np.argsort(pairs)
        self.pairs, self.order, self.made = pairs[sort], order[sort], made[sort]
        self.by_order = np.zeros(int(order.max(initial=0)) + 1, np.int64)
        self.by_order[order] = made
        self.special = special
        self._spelled: tuple[set[bytes], set[bytes], int] | None = None
        self._early: np.ndarray | None = None
        self.low = np.full(1 << 16, NEVER, np.int64)  # pairs of single bytes, which most look-ups are for
        a, b = np.meshgrid(bytes_to_id, bytes_to_id, indexing="ij")
        self.low[:] = self._search(a.ravel().astype(np.int64), b.ravel().astype(np.int64))

    def _search(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(left), NEVER)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.order[at], NEVER)

    def merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that stand one after the other in ``raw``, and how many each has. None is empty."""
        owner = np.arange(len(size))
        token = self.of_byte[raw].astype(np.int64)
        rank = np.full(len(token), NEVER, np.int64)
        if len(token) > 1:
            rank[:-1] = self.low[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        rank[np.cumsum(size) - 1] = NEVER
        owners, sizes, ids = [], [], []
        while len(owner):
            best = np.minimum.reduceat((rank << POSITION_BITS) + np.arange(len(rank)), np.cumsum(size) - size)
            done = (best >> POSITION_BITS) >= NEVER
            if done.any():
                ended = np.repeat(done, size)
                owners.append(owner[done])
                sizes.append(size[done])
                ids.append(token[ended].astype("<u4"))
                shift = np.cumsum(ended)  # places of the others once the ended ones are gone
                best = best[~done]
                at = best & PLACE
                best -= shift[at]
                token, rank, size, owner = token[~ended], rank[~ended], size[~done], owner[~done]
                if not len(owner):
                    break
            at = best & PLACE
            token[at] = self.by_order[best >> POSITION_BITS]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, rank = token[keep], rank[keep]
            at -= np.arange(len(at))
            size = size - 1
            after, before = np.minimum(at + 1, len(token) - 1), np.maximum(at - 1, 0)
            rank[at] = self._search(token[at], token[after])
            rank[before] = np.where(at > 0, self._search(token[before], token[at]), rank[before])
            rank[np.cumsum(size) - 1] = NEVER
        if not owners:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        flat, count = np.concatenate(ids), np.concatenate(sizes)
        order = np.argsort(np.concatenate(owners), kind="stable")
        return take_runs(flat, (np.cumsum(count) - count)[order], count[order]), count[order]

    def joins(self, data: bytes, at: int) -> bool:
        """If some token could hold the bytes on both sides of a place. Where none could, what is before and what is after it merge on
        their own, whatever stands there."""
        if self._spelled is None:
            tokens = {self.bytes[a : a + n].tobytes() for a, n in zip(self.starts.tolist(), self.lengths.tolist()) if n > 1}
            self._spelled = tokens, {t[:k] for t in tokens for k in range(1, len(t) + 1)}, int(self.lengths.max(initial=1))
        tokens, beginnings, longest = self._spelled
        for left in range(1, min(longest, at + 1)):
            head = data[at - left : at]
            if head not in beginnings:
                continue
            for right in range(1, longest - left + 1):
                both = data[at - left : at + right]
                if both in tokens:
                    return True
                if both not in beginnings or at + right >= len(data):
                    break
        return False

    def early(self) -> np.ndarray:
        """Which tokens are in a pair that merges before another pair makes the token. Places of a pair that makes one mustn't merge
        together, as the first may bring up a pair that goes before the second."""
        if self._early is None:
            born, self._early = np.full(self.size, -1, np.int64), np.zeros(self.size, bool)
            np.maximum.at(born, self.made, self.order)
            for part in (self.pairs // self.size, self.pairs % self.size):
                self._early[part[self.order < born[part]]] = True
        return self._early

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length: in runs that no token joins, all short ones together."""
        cuts, at, step = [0], APART, 1
        while at < len(piece):
            if self.joins(piece, at):
                step = min(2 * step, 4096) if at - cuts[-1] > 64 * APART else 1
                at += step
            else:
                cuts.append(at)
                at, step = at + APART, 1
        raw, starts = np.frombuffer(piece, np.uint8), np.array(cuts)
        sizes = np.diff(starts, append=len(piece))
        short = sizes <= MERGED_BYTES
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(starts)
        for rows in np.split(np.flatnonzero(short), range(MERGED_TOGETHER >> 2, int(short.sum()), MERGED_TOGETHER >> 2)):
            if len(rows):
                ids, count = self.merge(take_runs(raw, starts[rows], sizes[rows]), sizes[rows])
                for k, own in zip(rows.tolist(), np.split(ids, np.cumsum(count)[:-1])):
                    out[k] = own
        for k in np.flatnonzero(~short).tolist():
            own = piece[starts[k] : starts[k] + sizes[k]]
            out[k] = self.merge_rounds(own) if sizes[k] > HEAPED_BYTES else self.merge_heap(own)
        return np.concatenate(out)

    def merge_rounds(self, piece: bytes) -> np.ndarray:
        """Ids of one piece, all places of its best pair merged in each round: for long runs of few characters, which few rounds end. If places
        of a pair depend on each other, the heap does it."""
        raw = np.frombuffer(piece, np.uint8)
        token = self.of_byte[raw].astype(np.int32)
        rank = self.low[raw[:-1].astype(np.int32) * 256 + raw[1:]].astype(np.int32)
        del raw
        while len(rank) and (best := int(rank.min())) < NEVER:
            if self.early()[self.by_order[best]]:
                return self.merge_heap(piece)
            at = np.flatnonzero(rank == best)
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of places side by side, every second one
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            token[at] = self.by_order[best]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token = token[keep]
            rank = np.append(rank, np.int32(NEVER))[keep][: len(token) - 1]
            at -= np.arange(len(at))
            near = np.unique(np.concatenate([at - 1, at]))
            near = near[(near >= 0) & (near < len(rank))]
            for part in np.array_split(near, 1 + (len(near) >> 20)):
                rank[part] = self._search(token[part].astype(np.int64), token[part + 1].astype(np.int64))
        return token.astype("<u4")

    def merge_heap(self, piece: bytes) -> np.ndarray:
        """Ids of one piece, by a heap over a linked list."""
        raw = np.frombuffer(piece, np.uint8)
        token = self.of_byte[raw].astype(np.int64).tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.low[raw[:-1].astype(np.int64) * 256 + raw[1:]] if n > 1 else np.empty(0, np.int64)
        heap = [(r, i, token[i], token[i + 1]) for i, r in enumerate(first.tolist()) if r < NEVER]
        heapq.heapify(heap)
        table = self._dict()
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = int(self.by_order[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    s = table.get(token[x] * self.size + token[y])
                    if s is not None:
                        heapq.heappush(heap, (s, x, token[x], token[y]))
        return np.array([t for t in token if t >= 0], "<u4")

    def _dict(self) -> dict[int, int]:
        if not hasattr(self, "_table"):
            self._table = dict(zip(self.pairs.tolist(), self.order.tolist()))
        return self._table

    def decode(self, ids: np.ndarray) -> bytes:
        return spell(self.bytes, self.starts, self.lengths, ids)


#: A rank above all; bits for a place in a slice's tokens.
NEVER, POSITION_BITS = np.int64(1 << 24), 34
PLACE = np.int64((1 << POSITION_BITS) - 1)


def take_runs(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of a pool, joined."""
    return pool[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def spell(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The entries of a pool of byte strings, joined."""
    ids = ids.astype(np.int64)
    return take_runs(pool, starts[ids], lengths[ids]).tobytes()


def _from_ranks(path: str) -> Vocabulary:
    """A rank file: any two tokens merge whose joined bytes are a token; its rank is its id."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _lines(path))}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    size = len(tokens)
    pairs = [(ranks[t[:k]] * size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    key, made = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    return Vocabulary(tokens, np.array([ranks[bytes([b])] for b in range(256)]), key, made, made, {})


def _lines(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return f.read().splitlines()


def printable() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _from_json(path: str) -> Vocabulary:
    """A tokenizers file: only the listed pairs merge, in their order; special tokens are cut out of texts first."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError(f"{path}: not a plain byte-level BPE")
    vocabulary, byte = spec["model"]["vocab"], printable()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(c.isspace() for t in special for c in t):  # long texts are parted at spaces
        raise ValueError(f"{path}: a special token with white space")
    tokens = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
    for t, i in vocabulary.items():
        tokens[i] = t.encode() if t in special else bytes(byte[c] for c in t)
    for t, i in special.items():
        tokens[i] = t.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    key = np.array([vocabulary[a] * len(tokens) + vocabulary[b] for a, b in merges], np.int64)
    made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
    of_byte = np.array([vocabulary[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])])
    return Vocabulary(tokens, of_byte, key, np.arange(len(merges)), made, {t.encode(): i for t, i in special.items()})


_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first 8 and the next 8 bytes of byte ranges as 64-bit words, and their lengths."""
    words, length = eights(data), ends - starts
    low = words[starts] & _MASK[np.minimum(length, 8)]
    high = words[np.minimum(starts + 8, len(data) + 7)] & _MASK[np.clip(length - 8, 0, 8)]
    return low, high, length


def spread(low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of packed byte ranges."""
    return mix(low + mix(high + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class PieceCache:
    """An open-addressing table from packed pre-tokens to their ids, which are runs of a pool. Whole columns are found and
    added at once. A row has the two words and, in the third, length, number of ids and place in the pool."""

    def __init__(self, bits: int):
        self.mask, self.entries, self.most = np.uint64((1 << bits) - 1), 0, 1 << bits - 1
        self.rows = np.zeros((1 << bits, 3), np.uint64)
        self.pool, self.used = np.empty(1 << 16, "<u4"), 0

    def find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool and numbers of ids; 0 ids for what isn't there."""
        length = length.astype(np.uint64)
        found = np.zeros(len(low), np.uint64)
        at, left = spread(low, high, length) & self.mask, np.arange(len(low))
        while len(left):
            row = self.rows.take(at.astype(np.int64), 0)
            same = (row[:, 0] == low[left]) & (row[:, 1] == high[left]) & ((row[:, 2] & np.uint64(31)) == length[left])
            found[left[same]] = row[same, 2]
            on = ~same & (row[:, 2] != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        return (found >> np.uint64(16)).astype(np.int64), ((found >> np.uint64(8)) & np.uint64(255)).astype(np.int64)

    def add(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct pre-tokens that aren't there, with their ids one after the other; at most as many as there is room for, as
        a table must have free slots for a search to end."""
        room = max(0, self.most - self.entries)
        low, high, length, sizes = low[:room], high[:room], length[:room], sizes[:room]
        ids = ids[: int(sizes.sum())]
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + len(ids), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        place = self.used + np.cumsum(sizes) - sizes
        self.used, self.entries = self.used + len(ids), self.entries + len(low)
        row = np.column_stack([low, high, length.astype(np.uint64) | sizes.astype(np.uint64) << np.uint64(8) | place.astype(np.uint64) << np.uint64(16)])
        at, left = (spread(low, high, length) & self.mask).astype(np.int64), np.arange(len(low))
        while len(left):
            free = np.flatnonzero(self.rows[at[left], 2] == 0)
            _, first = np.unique(at[left[free]], return_index=True)
            won = free[first]
            self.rows[at[left[won]]] = row[left[won]]
            left = np.delete(left, won)
            at[left] = (at[left] + 1) & int(self.mask)


class Encoder:
    """Texts to ids, with a worker's cache of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cache = PieceCache(CACHE_BITS)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and for each byte range its place there and its number of ids."""
        if self.cache.entries >= self.cache.most:
            self.cache = PieceCache(CACHE_BITS)
        low, high, length = packed(data, starts, ends)
        short = length <= CACHED_BYTES
        if not short.all():
            low, high = np.where(short, low, 0), np.where(short, high, 0)
        place, size = self.cache.find(low, high, np.where(short, length, 0))
        pools, used = [self.cache.pool[: self.cache.used]], self.cache.used

        def put(rows: np.ndarray, ids: np.ndarray, count: np.ndarray, of: np.ndarray) -> None:
            nonlocal used
            place[rows], size[rows] = (used + np.cumsum(count) - count)[of], count[of]
            pools.append(ids)
            used += len(ids)

        miss = np.flatnonzero(short & (size == 0) & (length > 0))
        while len(miss):  # a second turn is for those whose hash is another pre-token's too
            _, first, of = np.unique(spread(low[miss], high[miss], length[miss]), return_index=True, return_inverse=True)
            new = miss[first]
            merged = [self.vocabulary.merge(take_runs(data, starts[k], length[k]), length[k]) for k in np.split(new, range(MERGED_TOGETHER, len(new), MERGED_TOGETHER))]
            ids, count = (np.concatenate([m[i] for m in merged]) for i in (0, 1))
            same = (low[miss] == low[new[of]]) & (high[miss] == high[new[of]]) & (length[miss] == length[new[of]])
            put(miss[same], ids, count, of[same])
            self.cache.add(low[new], high[new], length[new], ids, count)
            miss = miss[~same]
        rest = np.flatnonzero(~short)
        medium = rest[length[rest] <= MERGED_BYTES]
        for k in np.split(medium, range(MERGED_TOGETHER >> 2, len(medium), MERGED_TOGETHER >> 2)):
            if len(k):
                put(k, *self.vocabulary.merge(take_runs(data, starts[k], length[k]), length[k]), np.arange(len(k)))
        for k in rest[length[rest] > MERGED_BYTES].tolist():
            ids = self.vocabulary.merge_long(data[starts[k] : ends[k]].tobytes())
            put(np.array([k]), ids, np.array([len(ids)]), np.zeros(1, np.int64))
        return np.concatenate(pools) if len(pools) > 1 else pools[0], place, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and for each text (one more) the number of ids before it."""
        ids, bounds, _, _ = self.encode_spans(data, offsets)
        return ids, bounds

    def encode_spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As encode, with the bytes at which pre-tokens start and the number of ids before each."""
        ids, starts, before, at, n = [np.empty(0, "<u4")], [np.empty(0, np.int64)], [], 0, 0
        for part, bounds, begun in parts(data, offsets, self.vocabulary):
            own, where, count = self._spans(part, bounds)
            ids.append(own)
            starts.append(where[begun:] + at)
            before.append(count[begun:-1] + n)
            at, n = at + len(part), n + len(own)
        starts, before = np.concatenate(starts), np.concatenate([*before, [n]])
        return np.concatenate(ids), before[np.searchsorted(starts, offsets)], starts, before

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cuts, special = special_cuts(data, offsets, self.vocabulary.special)
        starts = pretokens(data, cuts)
        pool, place, size = self.lookup(data, starts, np.append(starts[1:], len(data)))
        if special:  # one id for all pre-tokens of a special string
            pool, size = np.append(pool, np.array([x[2] for x in special], "<u4")), size.copy()
            for k, (a, b, _) in enumerate(special):
                i, j = np.searchsorted(starts, (a, b))
                size[i:j] = 0
                place[i], size[i] = len(pool) - len(special) + k, 1
        return take_runs(pool, place, size), starts, np.concatenate([[0], np.cumsum(size)])


def parts(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """A slice of texts as it is, or a long text in parts, each of about SLICE_BYTES, that encode as the whole does, and if a part
    begins inside a pre-token. A text that can't be parted (a run of one character, say) stays whole."""
    a, n, begun = 0, len(data), False
    while len(offsets) == 2 and n - a > 2 * SLICE_BYTES:
        b, found = a + SLICE_BYTES, None
        while found is None and b < n:
            found = _cut(data, b, vocabulary)
            b += NEAR_BYTES
        if found is None:
            break
        yield data[a : found[0]], np.array([0, found[0] - a]), begun
        a, begun = found
    yield (data[a:], np.array([0, n - a]), begun) if a else (data, offsets, False)


def _cut(data: np.ndarray, b: int, vocabulary: Vocabulary) -> tuple[int, bool] | None:
    """A place in the NEAR_BYTES after b at which a text may be parted, and if it is inside a pre-token. After four code points of one class
    (no apostrophes, which may contract) the state of the scan is known: a pre-token starts at a code point of another class, and
    goes on at one of the same; there a part may end where no token joins both sides."""
    near = data[b - 1 : b + NEAR_BYTES]
    spaced = np.flatnonzero((near[1:] == 0x20) & (near[:-1] < 0x80) & ~WHITE_BYTE[near[:-1]])
    if len(spaced):  # before a space after a visible character
        return b + int(spaced[0]), False
    a, end = b - 64, min(len(data), b + NEAR_BYTES)
    while data[a] & 0xC0 == 0x80:
        a += 1
    while end > b and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    points = np.frombuffer(data[a:end].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < 8:
        return None
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at, kind = a + np.cumsum(width) - width, classes()[points]
    i = np.arange(4, len(points) - 1)
    steady = (kind[i - 1] < SPACE) & (at[i] >= b)
    for k in range(2, 5):
        steady &= kind[i - k] == kind[i - 1]
    for k in range(-4, 2):
        steady &= points[i + k] != 0x27
    i = i[steady]
    longest = max((len(t) for t in vocabulary.special), default=0)
    around = lambda k: data[max(k - longest + 1, 0) : k + longest - 1].tobytes()
    for inside, places in ((False, at[i[kind[i] != kind[i - 1]]][:64]), (True, at[i[kind[i] == kind[i - 1]]][:1024])):
        for k in places.tolist():
            if longest and any(t in around(k) for t in vocabulary.special):
                continue
            if not inside or not vocabulary.joins(data[max(k - 256, 0) : k + 256].tobytes(), min(k, 256)):
                return k, inside
    return None


def special_cuts(data: np.ndarray, offsets: np.ndarray, special: dict[bytes, int]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Offsets of texts and special strings, so that pre-tokens stop there; starts, ends and ids of the special strings."""
    found, blob = [], data.tobytes() if special else b""
    for text, number in special.items():
        k = blob.find(text)
        while k >= 0:
            row = int(np.searchsorted(offsets, k, "right")) - 1
            inside = k + len(text) <= offsets[row + 1]
            if inside:
                found.append((k, k + len(text), number))
            k = blob.find(text, k + (len(text) if inside else 1))
    if not found:
        return offsets, []
    return np.unique(np.concatenate([offsets, *(x[:2] for x in found)])), found


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return _from_ranks(path) if path.endswith(".tiktoken") else _from_json(path)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(vocabulary(path))
