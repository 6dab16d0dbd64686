"""Exact top-k search over integer vectors: tiled matrix products, partial selection, merged lists.

Each component x becomes floor(256 x). Products of a tile of queries and a tile of shards are
exact: in double precision while no sum can reach 2**53, else in whole numbers of any size
(scores beyond a BIGINT are held at its ends). Defined cases: see ``vectors``; zero vectors take part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import first_k, nearest, own_places

SCALE, EXACT = 256, 2.0**53
BLOCK = 256


def quantised(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(SCALE * data)


def matcher(k: int):
    def match(q_ids, q_data, ids, data):
        a, b = quantised(q_data), quantised(data)
        at, own = own_places(q_ids, ids)
        big = not np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT
        if big:  # floor(256 x) of any double as a whole number
            whole = lambda m: np.array([[int(x) * SCALE if abs(x) >= EXACT else int(np.floor(SCALE * x)) for x in row] for row in m], dtype=object).reshape(m.shape)
            a, b = whole(q_data), whole(data)
        found = []
        for s in range(0, len(a), BLOCK):
            score = a[s : s + BLOCK] @ b.T
            inside = (at >= s) & (at < s + BLOCK)
            if big:
                score = np.clip(score, -(2**63), 2**63 - 1)
                rows = []
                for i, row in enumerate(score):
                    row = [(-x, j) for j, x in enumerate(row) if j not in own[inside][at[inside] - s == i]]
                    rows += [(s + i, j, -x) for x, j in sorted(row)[:k]]
                q, v, n = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
            else:
                score[at[inside] - s, own[inside]] = -np.inf
                q, v = first_k(score, k)
                q, v, n = q + s, v, score[q, v].astype(np.int64)
            found.append((q, v, n))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3

    return match


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each vector whose id ``every`` divides."""
    return nearest(vectors, F.col("vec_id") % every == 0, k, matcher(k), "bigint", zero=True)
