"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, upto

ROW = "row long, vec_id long, dim int, vec binary, square double, pivots binary"
FOUND = "row long, query_id long, vec_id long, score long"
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Is the array neither null nor holding null or non-finite components?"""
    limit = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < limit) & (x > -limit)), F.lit(False))


def _matrix(cells: pd.Series, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=dtype).reshape(len(cells), width)


def _products(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products, cut to the range of a long."""
    top = float(np.abs(block.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).max(initial=0))
    if top * max(1, block.shape[1]) < EXACT:
        return (block.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(row, query)) for row in block]
    return np.array([min(LONG, max(-LONG, v)) for v in exact], dtype=np.int64)


def search(cands: pd.DataFrame, queries: pd.DataFrame, k: int, step: int = 512) -> list[tuple]:
    """The best k of one block of candidates for each query of one block.

    |d(q,p) - d(x,p)| <= d(q,x) for every pivot p, and q.x = (|q|^2 + |x|^2 -
    d(q,x)^2) / 2, so the largest difference over the pivots bounds the score
    from above. Candidates are evaluated in the order of their bounds; the
    search stops when the next bound is below the k-th score.
    """
    dim = int(cands["dim"].iloc[0])
    ids, rows = cands["vec_id"].to_numpy(), cands["row"].to_numpy()
    block = _matrix(cands["vec"], "<i8", dim)
    table = np.frombuffer(b"".join(cands["pivots"]), "<f8").reshape(len(cands), -1)
    square = cands["square"].to_numpy()
    found = []
    for q in queries.itertuples(index=False):
        vector, far = np.frombuffer(q.vec, "<i8"), np.frombuffer(q.pivots, "<f8")
        gap = np.abs(table - far).max(axis=1, initial=0.0)
        whole = square + q.square
        bound = (whole - gap * gap) / 2 + 1e-9 * whole + 1e-6
        order = np.argsort(-bound, kind="stable")
        order = order[rows[order] != q.row]
        best: list[tuple[int, int]] = []
        for at in range(0, len(order), step):
            part = order[at : at + step]
            if len(best) == k and best[-1][0] < -bound[part[0]]:
                break
            scores = _products(block[part], vector)
            if len(best) == k:
                keep = scores >= -best[-1][0]
                part, scores = part[keep], scores[keep]
            best = sorted(best + list(zip((-scores).tolist(), ids[part].tolist())))[:k]
        found += [(q.row, q.vec_id, i, -s) for s, i in best]
    return found


def top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = 32, cand_rows: int = 8192, query_rows: int = 2048
) -> DataFrame:
    """Each query's k best candidates by integer inner product.

    Components become floor(256 * x). Queries are the rows whose vec_id is
    divisible by ``every``; candidates are all rows but the query's own. Pivots
    are a bounded set of ``pivots`` rows (smallest hash); every row's distances
    to them are computed once. Rows are dealt to tiles of about ``cand_rows``
    candidates and ``query_rows`` queries, so that a task's memory doesn't grow
    with the table; each pair of tiles is searched, and k rows a query and tile
    are merged.

    Vectors that are null or hold null or non-finite components, and rows
    without a vec_id, take no part. Vectors are compared only with those of
    their own length. Rows that repeat a vec_id count as rows of their own.
    Scores beyond a long are cut to its range. Ties go to the smaller vec_id.
    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = vectors.where(finite(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("ints"),
    )
    sample = usable.orderBy(F.xxhash64("ints"), "vec_id").select("ints").limit(pivots).collect()
    points = [np.array(r[0], dtype=np.float64) for r in sample]

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, vec_id, ints in zip(batch["row"], batch["vec_id"], batch["ints"]):
                x = np.asarray(ints, dtype="<i8")
                f = x.astype(np.float64)
                far = np.array([np.linalg.norm(f - p) for p in points if len(p) == len(f)], dtype="<f8")
                out.append((row, vec_id, len(x), x.tobytes(), float(f @ f), far.tobytes()))
            yield pd.DataFrame(out, columns=["row", "vec_id", "dim", "vec", "square", "pivots"])

    rows = cut(usable.mapInPandas(prepared, ROW))
    asked = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), asked.count()
    tiles, packs = -(-max(n, 1) // cand_rows), -(-max(m, 1) // query_rows)
    cands = rows.withColumns({
        "tile": F.pmod(F.xxhash64("row"), F.lit(tiles)),
        "pack": upto(packs),
    })
    asked = asked.withColumns({
        "tile": upto(tiles),
        "pack": F.pmod(F.xxhash64("row", F.lit(1)), F.lit(packs)),
    })

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = search(left, right, k) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score"])

    # new names' ids, as both sides come from one table
    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))
    keys = ["tile", "pack", "dim"]
    found = cands.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(pair, FOUND)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
