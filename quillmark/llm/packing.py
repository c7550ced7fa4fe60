"""Best-fit packing of token sequences with swap-based local search."""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Below this codepoint both libraries have the same character classes (tests compare all), so the faster one encodes.
AGREED = "　"


class Encoder:
    """Ids of a text under one vocabulary, given for both libraries.

    They are the JSON file's library's; it takes a literal added token, such as
    the end of text, as that one token, so such texts go to it.
    """

    def __init__(self, ranks_path: str, json_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.slow = json_path, None
        with open(json_path, encoding="utf-8") as file:
            self.added = [token["content"] for token in json.load(file).get("added_tokens") or []]

    def ids(self, text: str) -> np.ndarray:
        if (text.isascii() or max(text) < AGREED) and not any(token in text for token in self.added):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[tuple, Encoder] = {}


def encoder(*key: str) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def best_fit(sizes: np.ndarray, capacity: int, items: list[int], bins: list[list[int]] | None = None) -> list[list[int]]:
    """``bins`` with ``items`` added in their order: each goes to the fullest bin that still has room, else to a new one.

    Bins are kept by room; the set bits of one integer are the rooms in use.
    """
    bins = [list(b) for b in bins or []]
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0

    def enter(room: int, where: int) -> None:
        nonlocal used
        by_room[room].append(where)
        if room:
            used |= 1 << room

    for where, held in enumerate(bins):
        enter(capacity - int(sizes[held].sum()), where)
    for item in items:
        size = int(sizes[item])
        fits = used >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            where = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
            bins[where].append(item)
        else:
            room, where = capacity, len(bins)
            bins.append([item])
        enter(room - size, where)
    return bins


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills, until bins empty.

    A source, the emptiest bin first, gives an item to another underfull bin (a
    move), or gives one for a smaller one there (one for one), or for two there
    whose sum is smaller (two for one). Offers of all other underfull bins are
    kept by ``key``, the size that would fill the bin exactly: its room plus
    what it would give back. So the least key not below an item's size is the
    change that leaves the bin fullest. Equal sizes in a bin are one offer, so a
    bin has at most about capacity offers. A bin that empties is dropped. The search ends at
    the lower bound, or when no bin has a change left: the sum of squares only
    grows, so it ends without a count of steps.
    """

    KINDS = ("move", "one for one", "two for one")

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes.tolist(), capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(self.sizes[x] for x in b) for b in bins]
        self.bound = -(-sum(self.fill) // capacity)
        self.alive = len(bins)
        self.applied = dict.fromkeys(self.KINDS, 0)
        self.version = [0] * len(bins)
        # by key: a heap of (-room, bin, version, items given back); stale ones go when met
        self.offers: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def _offer(self, b: int) -> None:
        """Enters what bin ``b`` would take and give back."""
        room = self.capacity - self.fill[b]
        if not room or not self.fill[b]:
            return
        by_size: dict[int, list[int]] = {}
        for x in self.bins[b]:
            by_size.setdefault(self.sizes[x], []).append(x)
        version, one = self.version[b], sorted(by_size)
        self._enter(room, (-room, b, version, ()))
        for i, size in enumerate(one):
            self._enter(room + size, (-room, b, version, (by_size[size][0],)))
            for other in one[:i]:
                self._enter(room + size + other, (-room, b, version, (by_size[size][0], by_size[other][0])))
            if len(by_size[size]) > 1:
                self._enter(room + 2 * size, (-room, b, version, tuple(by_size[size][:2])))

    def _enter(self, key: int, offer: tuple) -> None:
        heapq.heappush(self.offers[key], offer)
        self.used |= 1 << key

    def _take(self, source: int, size: int, most: int) -> tuple[int, int, tuple] | None:
        """(what stays free, bin, items given back) of the fullest fit that leaves under ``most`` free."""
        low, keys, key = self.fill[source], self.used >> size, size
        while keys:
            step = (keys & -keys).bit_length() - 1
            key += step
            free = key - size
            if free >= most:
                return None
            heap = self.offers[key]
            while heap and self.version[heap[0][1]] != heap[0][2]:
                heapq.heappop(heap)
            if not heap:
                self.used &= ~(1 << key)
            elif -heap[0][0] > free:
                room, b, _, back = heap[0]
                grown = -room - free
                if self.fill[b] - low + grown > 0:
                    return free, b, back
            keys >>= step + 1
            key += 1
        return None

    def _improve(self, source: int) -> bool:
        """Applies changes until ``source`` is empty or has none left; was there any?"""
        self.version[source] += 1
        changed = False
        while self.fill[source]:
            best = None
            for size, item in sorted({self.sizes[x]: x for x in self.bins[source]}.items(), reverse=True):
                found = self._take(source, size, self.capacity if best is None else best[0])
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], item, found[1], found[2])
                    if not found[0]:
                        break
            if best is None:
                break
            _, item, target, back = best
            self._apply(source, item, target, back)
            changed = True
        if self.fill[source]:
            self._offer(source)
        else:
            self.alive -= 1
        return changed

    def _apply(self, source: int, item: int, target: int, back: tuple) -> None:
        for x in back:
            self.bins[target].remove(x)
        self.bins[target].append(item)
        self.bins[source].remove(item)
        self.bins[source] += back
        grown = self.sizes[item] - sum(self.sizes[x] for x in back)
        self.fill[target] += grown
        self.fill[source] -= grown
        self.version[target] += 1
        self._offer(target)
        self.applied[self.KINDS[len(back)]] += 1

    def run(self) -> list[list[int]]:
        for b in range(len(self.bins)):
            self._offer(b)
        changed = True
        while changed and self.alive > self.bound:
            changed = False
            waiting = [(f, b) for b, f in enumerate(self.fill) if 0 < f < self.capacity]
            heapq.heapify(waiting)
            while waiting and self.alive > self.bound:
                fill, source = heapq.heappop(waiting)
                if self.fill[source] == fill:
                    changed |= self._improve(source)
        return [b for b in self.bins if b]


def pack(sizes: np.ndarray, capacity: int, applied: dict[str, int] | None = None) -> list[list[int]]:
    """Bins of item numbers; every size is 1..capacity.

    Items enter by classes of size, the large ones first, each class as it
    comes and best fit; after each the local search rearranges and empties bins,
    so that small items are left to fill what no exchange could. ``applied``,
    if given, adds up the changes of each kind.
    """
    bins: list[list[int]] = []
    above = capacity + 1
    for least in (capacity // 2, capacity // 8, capacity // 32, 1):
        items = np.flatnonzero((sizes >= least) & (sizes < above)).tolist()
        above = min(above, least)
        search = LocalSearch(best_fit(sizes, capacity, items, bins), sizes, capacity)
        bins = search.run()
        for kind, n in search.applied.items() if applied is not None else ():
            applied[kind] = applied.get(kind, 0) + n
    return bins


def token_pieces(docs: DataFrame, ranks_path: str, json_path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every document's token pieces of at most ``capacity``; the first may be shorter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks_path, json_path, pattern)
        for batch in batches:
            cells: list[tuple] = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"].array, batch["text"]):
                ids = np.append(encode.ids(text or ""), np.uint32(end_id)).astype("<u4")
                edges = list(range(len(ids) % capacity, len(ids) + 1, capacity))
                if edges[0]:
                    edges.insert(0, 0)
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    cells.append((row, doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(cells, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInPandas(run, PIECES)


def best_fit_packing(
    docs: DataFrame, ranks_path: str, json_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, tile_rows: int = 16_384
) -> DataFrame:
    """Packs all documents into sequences of ``capacity`` tokens.

    A document is its ids and one ``end_id``; only longer ones are cut. Full
    pieces are sequences of their own. The others are dealt by hash to tiles of
    about ``tile_rows`` pieces; a tile is packed by local search (:func:`pack`).
    Tiles of that size lose about a bin each, so more tiles cost nothing that grows; texts and ids are never shuffled, only lengths.

    Null and empty text: one token. A very long text is many pieces, encoded
    whole. Ties are broken by row. Repeated rows are packed each. An empty table gives an empty result; other columns are not
    read. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    ship(docs.sparkSession)
    pieces = cut(token_pieces(docs, ranks_path, json_path, pattern, capacity, end_id))
    whole = pieces.where(F.col("length") == capacity)
    whole = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    part = pieces.where(F.col("length") < capacity)
    tiles = max(1, -(-part.count() // tile_rows))

    def place(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["row", "piece"], ignore_index=True)
        sizes = tile["length"].to_numpy()
        sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        for number, items in enumerate(pack(sizes, capacity)):
            sequence[items] = (int(tile["tile"].iloc[0]) << 32) + number
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        return tile.drop(columns="tile").assign(sequence_id=sequence, offset=offset)

    tiled = part.withColumn("tile", F.pmod(F.xxhash64("row", "piece"), F.lit(tiles)))
    packed = tiled.groupBy("tile").applyInPandas(place, PLACES)
    return packed.unionByName(whole).drop("row")
