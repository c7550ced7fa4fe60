"""SimHash near-duplicates by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, ship
from .components import block_roots, connected

FAN = 4
#: Rows of units that are searched together; the last unit waits for its rest.
READ_ROWS = 10_000


def fingerprint(text: str, words: int = 3, seed: int = 42, block: int = 1 << 17) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; no words: zero."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    stop = np.cumsum(size) - 1
    start = stop - size + 1
    width = min(words, len(parts))
    starts, stops = start[: len(parts) - width + 1], stop[width - 1 :]
    total = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), block):
        edges = zip(starts[at : at + block].tolist(), stops[at : at + block].tolist())
        hashes = b"".join([digest(joined[a:b], seed) for a, b in edges])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def majority(hashes: np.ndarray, block: int = 1 << 17) -> int:
    """:func:`fingerprint` of given 64-bit hashes; none: zero."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), block):
        digests = hashes[at : at + block].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash) for every row; fp is the fingerprint's bits as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t or "") for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "fp": found.view(np.int64), "text_hash": batch["text_hash"]})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return slim.mapInPandas(run, "doc_id long, fp long, text_hash long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Places in Gray order: neighbours there share long masked bit patterns."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints of one unit in Gray order under nodes of up to FAN children.

    Each node keeps the bits that all below it share, as a mask and a pattern.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        ones = zeros = codes[self.order]
        zeros = ~zeros
        levels = [(ones, zeros)]
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            levels.append((ones, zeros))
        self.levels = [(ones | zeros, ones) for ones, zeros in reversed(levels)]

    def pairs(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the given codes) of all pairs that differ in ``limit`` bits or fewer.

        Goes down from (root, root). A pair of groups carries the differences
        found so far between bits both share; beyond ``limit`` all of it is
        pruned. A step adds only bits that became shared at this level.
        """
        left = right = np.zeros(1, dtype=np.int32)
        seen = np.zeros(1, dtype=np.uint64)
        total = np.zeros(1, dtype=np.uint8)
        spread = np.arange(FAN, dtype=np.int32)
        for depth, (mask, ones) in enumerate(self.levels):
            if depth:
                parent = np.repeat(np.arange(len(left), dtype=np.int32), FAN * FAN)
                left = (left[:, None, None] * np.int32(FAN) + spread[None, :, None] + np.zeros_like(spread)).ravel()
                right = (right[:, None, None] * np.int32(FAN) + spread[None, None, :] + np.zeros_like(spread)[:, None]).ravel()
                ok = (left <= right) & (right < len(mask))
                left, right, parent = left[ok], right[ok], parent[ok]
                seen, total = seen[parent], total[parent]
            both = mask[left] & mask[right]
            total = total + np.bitwise_count((ones[left] ^ ones[right]) & both & ~seen)
            ok = total <= limit
            left, right, seen, total = left[ok], right[ok], both[ok], total[ok]
        ok = left < right
        return self.order[left[ok]], self.order[right[ok]]


def nearest_forest(codes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the given links, by Boruvka's steps, a spanning forest with the fewest differing bits in all."""
    order = np.argsort(np.bitwise_count(codes[left] ^ codes[right]), kind="stable")
    left, right = left[order], right[order]
    lefts, rights = [left[:0]], [right[:0]]
    root = np.arange(len(codes))
    while True:
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
        if not len(left):
            return np.concatenate(lefts), np.concatenate(rights)
        best, link = np.full(len(codes), len(left)), np.arange(len(left))
        np.minimum.at(best, root[left], link)
        np.minimum.at(best, root[right], link)
        chosen = np.unique(best[best < len(left)])
        lefts.append(left[chosen])
        rights.append(right[chosen])
        root = block_roots(len(codes), np.concatenate(lefts), np.concatenate(rights))


def links_of(unit: np.ndarray, codes: np.ndarray, limit: int, small: int = 16, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs; ``unit`` numbers the units, whose codes stand together.

    A unit of up to ``small`` codes is one leaf and is compared directly, all
    such units at once; a larger one is searched through its own index, and its
    codes are linked to their roots. If ``direct``, only pairs within ``limit``
    are given, which are a spanning forest of all of them.
    """
    size = np.bincount(unit)[unit]
    lefts, rights = [], []
    for shift in range(1, min(small, len(unit))):
        near = np.flatnonzero((unit[shift:] == unit[:-shift]) & (size[shift:] <= small))
        near = near[np.bitwise_count(codes[near] ^ codes[near + shift]) <= limit]
        lefts.append(near)
        rights.append(near + shift)
    if direct and lefts:
        kept = nearest_forest(codes, np.concatenate(lefts), np.concatenate(rights))
        lefts, rights = [kept[0]], [kept[1]]
    first = np.flatnonzero(np.diff(unit, prepend=-1))
    for at in first[size[first] > small].tolist():
        left, right = GrayIndex(codes[at : at + size[at]]).pairs(limit)
        if direct:
            left, right = nearest_forest(codes[at : at + size[at]], left, right)
            lefts.append(left + at)
            rights.append(right + at)
            continue
        root = block_roots(int(size[at]), left, right)
        lefts.append(np.flatnonzero(root != np.arange(len(root))) + at)
        rights.append(root[root != np.arange(len(root))] + at)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def _next_masks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask``, cut into ``parts`` runs, each added to ``mask``."""
    bits = [b for b in range(64) if not mask >> b & 1]
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in bits[i:j]) for i, j in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def units(codes: DataFrame, limit: int, most: int) -> DataFrame:
    """(mask, pattern, fp): groups such that every pair within ``limit`` shares one.

    The upper nodes of the index: a unit is the codes with one pattern under one
    mask. The free bits are cut into limit + 1 runs; codes that close agree on
    one run at least, whose bits join the mask. A unit of over ``most`` codes is
    cut again by its free bits in the same way, so hot units are spread without
    dropping or capping a code. Distinct codes under a mask with b free bits are
    2^b at most, which ends the recursion.
    """
    level = codes.select("fp", F.lit(0).cast("long").alias("mask"))
    masks, done = [0], None
    while masks:
        table = {mask: _next_masks(mask, limit + 1) for mask in masks}
        entries = ", ".join(f"{_signed(m)}L, array({', '.join(f'{_signed(x)}L' for x in after)})" for m, after in table.items())
        level = level.select("fp", F.explode(F.element_at(F.expr(f"map({entries})"), F.col("mask"))).alias("mask"))
        level = level.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = level.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1")
        level = level.join(sizes, ["mask", "pattern"])
        masks = [a for after in table.values() for a in after if 1 << (64 - a.bit_count()) > most]
        masks = list(dict.fromkeys(masks))
        level = cut(level) if masks else level
        fit = level.where(F.col("n") <= most) if masks else level
        fit = fit.select("mask", "pattern", "fp")
        done = fit if done is None else done.unionByName(fit)
        level = level.where(F.col("n") > most)
        if masks and level.isEmpty():
            break
    return done


def index_links(codes: DataFrame, limit: int = 3, unit_rows: int = 1024, direct: bool = False) -> DataFrame:
    """(u, v): of every unit of the index, a spanning forest of the links of its codes (column fp, each once).

    If ``direct``, u and v themselves differ in ``limit`` bits or fewer, else they are linked by steps.
    """
    grouped = units(codes, limit, unit_rows).repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "fp")

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < READ_ROWS:
                continue
            rest = pd.concat(held, ignore_index=True)
            key = rest[["mask", "pattern"]].to_numpy()
            last = int((key[::-1] == key[-1]).all(axis=1).argmin()) if (key[0] != key[-1]).any() else len(key)
            if last < len(key):
                yield _forest(rest.iloc[: len(key) - last], limit, direct)
            held = [rest.iloc[len(key) - last :]]
        if held and sum(map(len, held)):
            yield _forest(pd.concat(held, ignore_index=True), limit, direct)

    return grouped.mapInPandas(forest, "u long, v long")


def simhash_components(docs: DataFrame, limit: int = 3, unit_rows: int = 1024) -> DataFrame:
    """Every document's fingerprint and the component of fingerprints it is in.

    Fingerprints of whole texts are linked at ``limit`` or fewer differing bits.
    Equal fingerprints become one code first, so copies cost nothing afterwards.
    Codes go to units (:func:`units`) of up to ``unit_rows``; within a unit they
    are searched through a Gray-order index, and only a spanning forest of the
    links leaves it. The forests are joined by :func:`connected`.

    Null and empty texts have fingerprint zero, which links like any other.
    Repeated rows each appear. A null doc_id is no component's number unless all
    are null. An empty table gives an empty result; other columns are not read.
    Returns doc_id, fingerprint (16 hex digits), component_id, text_hash.
    """
    rows = cut(fingerprints(docs))
    codes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    roots = connected(index_links(codes, limit, unit_rows))
    classes = roots.join(codes, roots["node"] == codes["fp"]).groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(classes, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("joined"))
    known = codes.join(linked, "fp", "left").select("fp", "copies", F.coalesce("joined", "first").alias("component_id"))
    return _labelled(rows, known).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash"
    )


def _labelled(rows: DataFrame, known: DataFrame, share: int = 1_000) -> DataFrame:
    """``rows`` with their code's component.

    Codes of over 1 / ``share`` of the rows, of which there are ``share`` at
    most, are broadcast, so that a hot code's rows stay where they are; the
    others are joined by code.
    """
    least = rows.count() / share
    hot = F.broadcast(known.where(F.col("copies") > least).select("fp", "component_id"))
    cold = known.where(F.col("copies") <= least).select("fp", "component_id")
    few = rows.join(hot, "fp")
    return few.unionByName(rows.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component of :func:`simhash_components`.

    The row of smallest doc_id stays (null last, then by a hash of the text);
    of rows equal in both, one. Its columns stay as they are.
    """
    found = simhash_components(docs)
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    return kept_rows(docs, found.select("doc_id", group.alias("group"), "text_hash"))


#: Keys of rows that go, up to which they are broadcast (some 60 bytes each) and the texts stay where they are.
BROADCAST_ROWS = 1_000_000


def kept_rows(docs: DataFrame, grouped: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` cut to one row of each group of ``grouped`` (doc_id, group, text_hash), as :func:`one_of_each` says.

    Rows are known by doc_id and text hash. Those that go are the smaller side:
    up to ``broadcast_rows`` of them, counted first, are broadcast, so no text
    is shuffled; beyond, texts meet the rows that stay in a semi join. Rows
    equal in both are told apart only where there are any.
    """
    key, digest, other, same, nth = fresh(docs, "_key", "_sum", "_id", "_hash", "_n")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    grouped = cut(grouped)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    keep = grouped.groupBy("group").agg(best).select(name(F.col("best.doc_id")).alias(other), F.col("best.text_hash").alias(same)).distinct()
    known = grouped.groupBy(name(F.col("doc_id")).alias(other), F.col("text_hash").alias(same)).agg(F.count("*").alias("n"))
    known = cut(known.join(keep.withColumn("stays", F.lit(True)), [other, same], "left"))
    repeats = known.where("stays and n > 1").select(other, same)
    going = known.where("stays is null").select(other, same)
    rows = docs.withColumns({key: name(F.col("doc_id").cast("long")), digest: F.xxhash64("text")})
    on = (F.col(key) == F.col(other)) & (F.col(digest) == F.col(same))
    n_going, n_repeats = going.count(), repeats.count()
    if n_going + n_repeats > broadcast_rows:
        rows = rows.join(known.where("stays").select(other, same), on, "left_semi")
        copies = Window.partitionBy(key, digest).orderBy(key)
        return rows.withColumn(nth, F.row_number().over(copies)).where(F.col(nth) == 1).select(docs.columns)
    once = rows.join(F.broadcast(going.unionByName(repeats)), on, "left_anti").select(docs.columns)
    if not n_repeats:
        return once
    copies = Window.partitionBy(key, digest).orderBy(key)
    several = rows.join(F.broadcast(repeats), on, "left_semi").withColumn(nth, F.row_number().over(copies))
    return once.unionByName(several.where(F.col(nth) == 1).select(docs.columns))


def _forest(rows: pd.DataFrame, limit: int, direct: bool) -> pd.DataFrame:
    key = rows[["mask", "pattern"]].to_numpy()
    unit = np.cumsum(np.append(0, (key[1:] != key[:-1]).any(axis=1)))
    signed = rows["fp"].to_numpy()
    left, right = links_of(unit, signed.view(np.uint64), limit, direct=direct)
    return pd.DataFrame({"u": signed[left], "v": signed[right]})
