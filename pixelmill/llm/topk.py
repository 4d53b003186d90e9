"""Exact top-k inner-product search: tiled matrix products, partial selection per tile, tree merge of top lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _util as U

#: Rows of a tile's candidate and query side, tiles wanted at least, and top lists that one merge step joins.
CANDIDATE_ROWS, QUERY_ROWS, LEAST_TILES, FAN_IN = 16384, 8192, 12, 16


def quantise(df: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) with v = floor(scale * x) for each row; vectors that are null, or hold a null or
    non-finite component, take no part, nor do rows without an id. Rows that repeat an id all stay."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def whole(e):
        y = e.cast("double") * scale
        return F.when(F.abs(y) >= 2.0**53, y).otherwise(F.floor(y).cast("double"))

    return df.where(F.col(id_col).isNotNull() & x.isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def tile_top(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of every query of one tile: highest product first, then the smaller id.

    Products are exact: in float64 where no sum can pass 2**53, else in Python integers.
    """
    c = c.sort_values(["vec_id", "row"], kind="stable")
    width = max(c.v.map(len).max(), q.v.map(len).max())
    a, b = _matrix(q.v, width), _matrix(c.v, width)
    qid, cid, qrow, crow = q.vec_id.to_numpy(), c.vec_id.to_numpy(), q.row.to_numpy(), c.row.to_numpy()
    by_row = np.argsort(crow, kind="stable")
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    exact = most < 2**53
    if not exact:
        a, b = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (a, b))
    out, step = [], max(1, 4_000_000 // len(cid))
    for i in range(0, len(qid), step):
        s = a[i : i + step] @ b.T
        rows = np.arange(len(s))
        own = by_row[np.minimum(np.searchsorted(crow, qrow[i : i + step], sorter=by_row), len(cid) - 1)]
        mine = crow[own] == qrow[i : i + step]
        if exact and most * (len(cid) + 1) < 2**62:
            key = s.astype(np.int64) * len(cid) - np.arange(len(cid))
            key[rows[mine], own[mine]] = -(2**62)
            m = min(k, len(cid))
            top = np.argpartition(-key, m - 1, axis=1)[:, :m] if m < len(cid) else np.tile(np.arange(len(cid)), (len(s), 1))
        else:
            top = np.array([sorted(range(len(cid)), key=lambda j, r=r: (-r[j], j))[: k + 1] for r in s])
        who, asks = np.repeat(qid[i : i + step], top.shape[1]), np.repeat(qrow[i : i + step], top.shape[1])
        cand, score = cid[top].ravel(), np.take_along_axis(s, top, 1).ravel()
        keep = asks != crow[top].ravel()
        score = np.clip(score[keep], -(2**63), 2**63 - 1)
        out.append(pd.DataFrame({"query_row": asks[keep], "query_id": who[keep], "vec_id": cand[keep], "score": score.astype(np.int64) if exact else [int(x) for x in score]}))
    return pd.concat(out, ignore_index=True)


def numbered(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``row``, a number of its own for each row, stored so that nothing computed again changes it."""
    return U.checkpoint(vectors.withColumn("row", F.monotonically_increasing_id()))


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (vec_id, v, row) its k best rows of ``candidates``
    (the same columns); queries are rows of numbered() candidates, and a query's own row is left out.

    Rows that repeat an id are queries and candidates each; ties go to the smaller id; fewer candidates than k give all
    of them; missing components of shorter vectors count as zero; scores beyond a long are held at its ends; other
    columns are not read; empty inputs give no rows. Both sides are dealt into tiles of bounded size, so no task
    gathers either table.
    """
    n, nq = candidates.count(), queries.count()
    cg = max(1, -(-n // CANDIDATE_ROWS), min(LEAST_TILES, -(-n // 512)))
    qg = max(1, -(-nq // QUERY_ROWS))

    def dealt(df: DataFrame, side: int, own: str, groups: int, other: str, others: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return df.select("qg", "cg", F.lit(side).alias("side"), "row", "vec_id", "v")

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        q, c = rows[rows.side == 0], rows[rows.side == 1]
        if q.empty or c.empty:
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": [], "tile": []}).astype("int64")
        return tile_top(q, c, k).assign(tile=int(key[1]))

    both = dealt(queries, 0, "qg", qg, "cg", cg).union(dealt(candidates, 1, "cg", cg, "qg", qg))
    tiles = both.groupBy("qg", "cg").applyInPandas(top, "query_row long, query_id long, vec_id long, score long, tile int")
    while True:
        last = cg <= FAN_IN
        w = Window.partitionBy("query_row", *([] if last else [F.floor(F.col("tile") / FAN_IN)])).orderBy(F.desc("score"), "vec_id")
        tiles = tiles.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if last:
            return tiles.select("query_id", "rank", "vec_id", "score")
        tiles = tiles.select("query_row", "query_id", "vec_id", "score", F.floor(F.col("tile") / FAN_IN).cast("int").alias("tile"))
        cg = -(-cg // FAN_IN)
