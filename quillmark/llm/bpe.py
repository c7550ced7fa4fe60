"""Byte-level BPE: vectorised pre-tokenisation, cached merging, decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import ship

# Character classes.
LETTER, NUMBER, SPACE, WHITE, OTHER = range(5)
# Symbols of the automaton: the first three classes that make runs, an apostrophe
# that opens a contraction of two or three characters, a space or other white
# space before a character that isn't white, white space before white space or
# the end, and the end of a text.
S_LETTER, S_NUMBER, S_OTHER, S_TWO, S_THREE, S_PREFIX, S_SINGLE, S_WHITE, S_END = range(9)
# States: at a boundary, inside a run of a class, after a prefix space, one or
# two characters of a contraction to come.
BOUND, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, PREFIXED, ONE_MORE, TWO_MORE = range(8)
#: White space as the pattern's \\s has it (fixed values: Unicode White_Space).
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 64
CACHE_ENTRIES = 400_000


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and starts[state, symbol]: does a piece start there?"""
    step = np.zeros((8, 9), dtype=np.uint8)
    starts = np.ones((8, 9), dtype=bool)
    run = {S_LETTER: IN_LETTER, S_NUMBER: IN_NUMBER, S_OTHER: IN_OTHER}
    for state in range(8):
        for symbol, inside in run.items():
            step[state, symbol] = inside
            starts[state, symbol] = state not in (inside, PREFIXED)
        for symbol, inside in ((S_TWO, ONE_MORE), (S_THREE, TWO_MORE)):
            joined = state in (IN_OTHER, PREFIXED)
            step[state, symbol], starts[state, symbol] = (IN_OTHER, False) if joined else (inside, True)
        step[state, S_PREFIX] = PREFIXED
        step[state, S_SINGLE] = BOUND
        step[state, S_WHITE], starts[state, S_WHITE] = IN_WHITE, state != IN_WHITE
        step[state, S_END] = BOUND
    for symbol in range(5):
        step[TWO_MORE, symbol], starts[TWO_MORE, symbol] = ONE_MORE, False
        step[ONE_MORE, symbol], starts[ONE_MORE, symbol] = BOUND, False
    return step, starts


class Classes:
    """Codepoint classes, made once a process."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            kinds = {"L": LETTER, "N": NUMBER}
            table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
            table[WHITE_SPACE] = WHITE
            table[0x20] = SPACE
            cls.table = table
        return cls.table


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each position's symbol, from its class and the two characters after it.

    ``ends`` are the positions of the separators between texts.
    """
    kinds = Classes.get()[points]
    kinds[ends] = 255
    symbol = np.array([S_LETTER, S_NUMBER, S_WHITE, S_WHITE, S_OTHER], dtype=np.uint8)[np.minimum(kinds, 4)]
    after = np.append(kinds[1:], 255)
    solid = (after != SPACE) & (after != WHITE) & (after != 255)
    symbol[(kinds == SPACE) & solid] = S_PREFIX
    symbol[(kinds == WHITE) & solid] = S_SINGLE
    at = np.flatnonzero(points == 39)
    if len(at):
        more = np.concatenate([points, np.zeros(2, points.dtype)])
        more[ends] = 0
        one, two = more[at + 1], more[at + 2]
        symbol[at[np.isin(one, [ord(c) for c in "stmd"])]] = S_TWO
        pairs = [(one == ord(p[0])) & (two == ord(p[1])) for p in ("re", "ve", "ll")]
        symbol[at[pairs[0] | pairs[1] | pairs[2]]] = S_THREE
    symbol[ends] = S_END
    return symbol


def piece_starts(symbol: np.ndarray) -> np.ndarray:
    """Positions where a piece starts, by an associative scan of transitions.

    A symbol is a function from states to states, and composing functions is
    associative. Blocks of symbols are composed side by side, the blocks'
    functions by doubling, which gives the state before each block; then all
    blocks are walked at once.
    """
    step, starts = automaton()
    n = len(symbol)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, S_END, dtype=np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat = step.ravel()
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
    for column in grid:
        whole = flat[whole * np.uint8(9) + column]
    size = 1
    while size < rows:
        whole[:, size:] = np.take_along_axis(whole[:, size:], whole[:, :-size].astype(np.intp), axis=0)
        size *= 2
    state = np.zeros(rows, dtype=np.uint8)
    state[1:] = whole[BOUND, :-1]
    found = np.empty((BLOCK, rows), dtype=bool)
    mark = starts.ravel()
    for i, column in enumerate(grid):
        key = state * np.uint8(9) + column
        found[i] = mark[key]
        state = flat[key]
    return np.flatnonzero(found.T.reshape(-1)[:n])


class Merger(dict):
    """piece -> its ids as little-endian 32-bit integers, filled as pieces come."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.tokens = {rank: token for token, rank in self.ranks.items()}

    def __missing__(self, piece: bytes) -> bytes:
        out = self.packed.get(piece) or self.merge(piece)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(piece) <= 128:
            self[piece] = out
        return out

    def merge(self, piece: bytes) -> bytes:
        """Joins the neighbours of lowest rank, leftmost first, until none can."""
        if len(piece) > 200:
            return self._merge_long(piece)
        rank, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        worth = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while worth and (low := min(worth)) < none:
            i = worth.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del worth[i]
            if i:
                worth[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(worth):
                worth[i] = rank(parts[i] + parts[i + 1], none)
        packed = self.packed
        return b"".join([packed[p] for p in parts])

    def _merge_long(self, piece: bytes) -> bytes:
        """The same with a heap over a linked list, for long pieces."""
        rank, n = self.ranks.get, len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(both := part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, len(both)))
        return b"".join([self.packed[p] for p in part if p is not None])


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def encode(texts: list[str], path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its ids and the byte offset where each id's bytes start, plus the end."""
    return [(np.frombuffer(packed, "<u4"), offsets) for packed, offsets in _encoded(texts, merger(path))]


def _encoded(texts: list[str], cache: Merger) -> Iterator[tuple[bytes, np.ndarray]]:
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    begin = piece_starts(symbols(points, ends))
    data = joined.encode()
    if len(data) != len(points):
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width) - width
        begin, ends = place[begin], place[ends]
    last = np.searchsorted(begin, ends)
    begin = begin.tolist()
    first = 0
    for end in last.tolist():
        edges = begin[first : end + 1]
        pieces = [cache[data[a:b]] for a, b in zip(edges, edges[1:])]
        first = end + 1
        packed = b"".join(pieces)
        yield packed, _offsets(packed, cache)


def _offsets(packed: bytes, cache: Merger) -> np.ndarray:
    ids = np.frombuffer(packed, "<u4")
    if not hasattr(cache, "lengths"):
        cache.lengths = np.array([len(cache.tokens.get(i, b"")) for i in range(max(cache.tokens) + 1)], dtype=np.int64)
    return np.concatenate([[0], np.cumsum(cache.lengths[ids])])


def decode(ids: np.ndarray, path: str, offsets: np.ndarray | None = None, start: int = 0, end: int | None = None) -> bytes:
    """The bytes of ``ids``; with the retained ``offsets``, those from byte ``start`` to ``end``.

    With offsets, only the ids that cover the range are looked up.
    """
    tokens = merger(path).tokens
    if offsets is None:
        return b"".join([tokens[i] for i in ids.tolist()])[start:end]
    end = int(offsets[-1]) if end is None else end
    first = max(0, int(np.searchsorted(offsets, start, side="right")) - 1)
    last = int(np.searchsorted(offsets, end, side="left"))
    base = int(offsets[min(first, len(offsets) - 1)])
    return b"".join([tokens[i] for i in ids[first:last].tolist()])[start - base : end - base]


def chunked(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together, one text at least."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text; returns counts and digests.

    Texts are cut into pieces by the automaton above, without a regular
    expression, several texts at a time; pieces are merged by rank through a
    bounded cache. Decoding goes back over the retained offsets. No shuffle: a
    row's result depends on its text alone. Null texts are empty: no ids.
    Repeated rows are kept, other columns are not read. Returns doc_id,
    n_tokens, ids_sha256, decoded_sha256, n_bytes.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = merger(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            out: list[tuple] = []
            for a, b in chunked(texts):
                for packed, offsets in _encoded(texts[a:b], cache):
                    ids = np.frombuffer(packed, "<u4")
                    back = decode(ids, path, offsets)
                    out.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)))
            done = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])
            done.insert(0, "doc_id", batch["doc_id"].array)
            yield done

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return slim.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
