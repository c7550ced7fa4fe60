"""Near-duplicate vectors by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, upto
from .components import block_roots, connected
from .topk import finite

UNIT = "row long, vec_id long, dim int, vec binary, home int, probes array<int>"


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's iterations from k distinct points (fewer, if there are fewer)."""
    points = np.unique(points, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = _squares(points, centres).argmin(axis=1)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T)


def traverse(first: np.ndarray, second: np.ndarray, most: int, until: int = -1) -> list[int]:
    """Cells (i, j), as i * len(second) + j, in the order of first[i] + second[j].

    The multi-sequence algorithm: a heap holds the frontier of the sorted grid;
    (i, j) enters once (i-1, j) and (i, j-1) have left. Stops after ``most``
    cells or at the cell ``until``.
    """
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    heap, gone, out = [(x[0] + y[0], 0, 0)], [0] * (len(a) + 1), []
    # gone[i]: how many cells of sorted row i have left the heap
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        gone[i] = j + 1
        out.append(a[i] * len(b) + b[j])
        if out[-1] == until:
            break
        if i + 1 < len(a) and gone[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or gone[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return out


def visits_needed(sample: np.ndarray, books: tuple, cosine: float, recall: float, seed: int = 11) -> int:
    """Visits after which a share ``recall`` of pairs at exactly ``cosine`` meet.

    Every sample vector gets a partner in a random direction at that cosine, the
    hardest pair the contract holds; a pair meets when either's traversal has
    reached the other's cell.
    """
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=sample.shape)
    noise -= (noise * sample).sum(1, keepdims=True) * sample
    length = np.linalg.norm(noise, axis=1, keepdims=True)
    other = cosine * sample + np.sqrt(1 - cosine**2) * np.divide(noise, length, out=np.zeros_like(noise), where=length > 0)
    half = sample.shape[1] // 2
    sides = [[_squares(p[:, s], book) for s, book in zip((slice(0, half), slice(half, None)), books)] for p in (sample, other)]
    width = len(books[1])
    homes = [f.argmin(1) * width + s.argmin(1) for f, s in sides]
    ranks = []
    most = len(books[0]) * width
    for n in range(len(sample)):
        one = len(traverse(sides[0][0][n], sides[0][1][n], most, homes[1][n]))
        ranks.append(min(one, len(traverse(sides[1][0][n], sides[1][1][n], one, homes[0][n]))))
    return int(np.quantile(ranks, recall, method="higher")) if ranks else 1


def _linked(cands: pd.DataFrame, queries: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one block of a cell's vectors with one block of its visitors.

    Verified by cosine. Gives counts a vector and, of the links, a spanning
    forest: the links themselves stay inside the block. A link is counted for
    the visitor; also for the visited if its own visits leave out the visitor's
    home cell, so that both ends count each link once.
    """
    dim = int(cands["dim"].iloc[0])
    block = np.frombuffer(b"".join(cands["vec"]), "<f8").reshape(-1, dim)
    asked = np.frombuffer(b"".join(queries["vec"]), "<f8").reshape(-1, dim)
    rows, own = cands["row"].to_numpy(), queries["row"].to_numpy()
    home = queries["home"].to_numpy()
    probes = np.stack(cands["probes"].to_numpy())
    lefts, rights = [], []
    for at in range(0, len(asked), 1024):
        left, right = np.nonzero(asked[at : at + 1024] @ block.T >= cosine)
        lefts.append(left + at)
        rights.append(right)
    left, right = np.concatenate(lefts), np.concatenate(rights)
    other = own[left] != rows[right]
    left, right = left[other], right[other]
    one_way = np.ones(len(left), dtype=bool)
    for at in range(0, len(left), 1 << 16):
        part = slice(at, at + (1 << 16))
        one_way[part] = ~(probes[right[part]] == home[left[part]][:, None]).any(axis=1)
    nodes, index = np.unique(np.concatenate([own[left], rows[right]]), return_inverse=True)
    u, v = index[: len(left)], index[len(left) :]
    count = np.bincount(u, minlength=len(nodes)) + np.bincount(v[one_way], minlength=len(nodes))
    return pd.DataFrame({"row": nodes, "n": count, "root": nodes[block_roots(len(nodes), u, v)] if len(nodes) else nodes})


def near_vectors(
    vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995, cell_rows: int = 512, block_rows: int = 2048,
    sample_rows: int = 20_000, calibrate_rows: int = 2_000, most_codes: int = 1024,
) -> DataFrame:
    """Every vector's links (cosine >= ``cosine``, double precision) and component.

    Unit vectors are cut in two halves with a codebook each, fitted on
    ``sample_rows`` rows of smallest hash at most; the codebooks' product is a
    grid with about ``cell_rows`` vectors a cell. All vectors are indexed in
    their own cell. Each visits its nearest cells in multi-sequence order, as
    many as a calibration at the threshold needs to reach ``recall``, and is
    verified against their members. Members and visitors of a cell are dealt to
    blocks of ``block_rows``, so one hot cell is many tasks, and only counts and
    spanning forests leave a block.

    Null and zero vectors and those with null or non-finite components link with
    nothing, and so do vectors of different lengths. Repeated vec_ids are rows
    of their own that share a component number's order. An empty table gives an
    empty result. Returns vec_id, n_links, component_id, kept.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
    )
    ok = finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    base = cut(base.withColumn("embedding", F.when(ok, F.col("embedding"))))
    usable = base.where(F.col("embedding").isNotNull())
    total = usable.count()
    sample = usable.orderBy(F.xxhash64("embedding"), "row").select("embedding").limit(sample_rows).toPandas()["embedding"]
    alone = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(sample):
        return alone
    width = max(2, max(map(len, sample)))
    half = width // 2

    def unit(value) -> np.ndarray:
        x = np.asarray(value, dtype=np.float64)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    def padded(units: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(units), width))
        for i, x in enumerate(units):
            out[i, : min(width, len(x))] = x[:width]
        return out

    points = padded([unit(x) for x in sample])
    codes = int(min(most_codes, max(1, round((total / cell_rows) ** 0.5))))
    books = (kmeans(points[:, :half], codes), kmeans(points[:, half:], codes))
    visits = visits_needed(points[:calibrate_rows], books, cosine, recall)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = [unit(x) for x in batch["embedding"]]
            whole = padded(units)
            first, second = _squares(whole[:, :half], books[0]), _squares(whole[:, half:], books[1])
            probes = [traverse(f, s, visits) for f, s in zip(first, second)]
            yield pd.DataFrame({
                "row": batch["row"], "vec_id": batch["vec_id"], "dim": [len(x) for x in units],
                "vec": [x.astype("<f8").tobytes() for x in units], "home": [p[0] for p in probes], "probes": probes,
            })

    units = cut(usable.mapInPandas(index, UNIT))
    asked = units.withColumn("cell", F.explode("probes"))
    sizes = units.groupBy("dim", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    packs = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("packs"))
    sizes = cut(sizes.join(packs, ["dim", "cell"]))
    members = units.withColumn("cell", F.col("home")).join(sizes, ["dim", "cell"]).withColumns({
        "part": F.pmod(F.xxhash64("row"), F.col("parts")), "pack": upto(F.col("packs")),
    })
    visitors = asked.join(sizes, ["dim", "cell"]).withColumns({
        "part": upto(F.col("parts")), "pack": F.pmod(F.xxhash64("row", F.lit(1)), F.col("packs")),
    })
    keys = ["dim", "cell", "part", "pack"]
    members = members.select(*keys, "row", "vec", "probes")
    visitors = visitors.select(*(F.col(c).alias(c) for c in [*keys, "row", "vec", "home"]))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "n": [], "root": []})
        return _linked(left, right, cosine)

    found = cut(members.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInPandas(pair, "row long, n long, root long"))
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    roots = connected(found.select(F.col("row").alias("u"), F.col("root").alias("v")))
    ids = usable.select(F.col("row").alias("node"), "vec_id").join(roots, "node")
    classes = ids.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    parts = roots.join(classes, "root").select(F.col("node").alias("row"), "component_id")
    return base.select("row", "vec_id").join(counts, "row", "left").join(parts, "row", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
