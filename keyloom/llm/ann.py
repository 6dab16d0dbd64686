"""Approximate nearest neighbours by collision counting (query-aware hashing).

Inner product becomes distance: within a tile each vector gets one more coordinate that brings
its length to the tile's longest, and queries are scaled to that length. A tile's index is m
arrays, each the tile's vectors sorted by one random projection. For a query, windows of half
width w centred at its own projections count how many arrays a vector lies close in; virtual
rehashing widens the windows step by step. A window is a stretch of places in the sorted array,
so a vector collides if its place there (kept beside the array) falls in the stretch. A vector
that has collided in ``threshold`` arrays is verified by its exact inner product. The search of a tile
ends when its k-th best lies so near that a vector at that distance would have reached the
threshold with probability ``SURE``, or when all are verified; there is no cap
on candidates. Every row is indexed, no index is fitted to a sample.

Defined cases: see ``vectors``; zero vectors take no part. Ties go to the smaller vec_id; equal
vectors collide alike and are all verified.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import nearest, own_places

PROJECTIONS, THRESHOLD, SURE = 96, 66, 0.85
#: The first windows as a share of those at which a search over a small sample would end, and the growth of a step.
FIRST, WIDER = 0.8, 1.15
SAMPLE = 512


@lru_cache
def reach(m: int = PROJECTIONS, threshold: int = THRESHOLD, sure: float = SURE) -> float:
    """z: windows of half width z d catch a vector at distance d in ``threshold`` of m arrays with probability ``sure``."""
    low, high = 0.0, 8.0
    for _ in range(60):
        z = (low + high) / 2
        p = math.erf(z / math.sqrt(2))
        caught = sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(threshold, m + 1))
        low, high = (z, high) if caught < sure else (low, z)
    return high


def search_tile(q_ids, q_data, ids, data, k: int, seed: int = 5, spent: list | None = None):
    """(query places, shard places, scores) of the best k found in one tile; ``spent`` gets the number of verified vectors."""
    n, dim = data.shape
    if n > 65_535:
        raise ValueError("a tile's places take 16 bits")
    if not len(q_ids) or not n:
        return (np.empty(0, np.int64),) * 3
    z = reach()
    norms = np.sqrt(np.einsum("ij,ij->i", data, data))
    longest = norms.max()
    lift = np.sqrt(np.maximum(longest**2 - norms**2, 0.0))
    axes = np.random.default_rng([seed, dim]).standard_normal((dim + 1, PROJECTIONS))
    shadow = data @ axes[:dim] + lift[:, None] * axes[dim]
    order = np.argsort(shadow, axis=0, kind="stable")
    lines = np.ascontiguousarray(np.take_along_axis(shadow, order, axis=0).T)
    places = np.empty((PROJECTIONS, n), np.uint16)
    for j in range(PROJECTIONS):
        places[j, order[:, j]] = np.arange(n, dtype=np.uint16)
    q_norms = np.sqrt(np.einsum("ij,ij->i", q_data, q_data))
    q_shadow = (q_data / q_norms[:, None]) @ axes[:dim] * longest
    own_query, own_place = own_places(q_ids, ids)

    def distance(score, i):  # of the lifted vectors, from the inner product
        return math.sqrt(max(2 * longest**2 - 2 * longest * score / q_norms[i], 0.0))

    some = np.random.default_rng([seed, n]).choice(n, min(n, SAMPLE), replace=False)
    seen = q_data @ data[some].T
    kth = np.partition(seen, -min(k, len(some)), axis=1)[:, -min(k, len(some))]
    width = np.array([FIRST * z * distance(s, i) for i, s in enumerate(kth)]) + 1e-12 * longest
    out_q, out_v, out_s = [], [], []
    active = np.arange(len(q_ids))
    done = {i: (np.zeros(n, bool), np.empty(0, np.int64), np.empty(0)) for i in active.tolist()}
    while len(active):
        at, w = q_shadow[active], width[active]
        left = np.stack([np.searchsorted(x, at[:, j] - w, "left") for j, x in enumerate(lines)], axis=1)
        right = np.stack([np.searchsorted(x, at[:, j] + w, "right") for j, x in enumerate(lines)], axis=1)
        going = []
        for a, i in enumerate(active.tolist()):
            verified, place, best = done.pop(i)
            inside = places - left[a].astype(np.uint16)[:, None] < (right[a] - left[a]).astype(np.uint16)[:, None]  # wraps below the left end
            hit = inside.sum(axis=0, dtype=np.uint8) >= THRESHOLD
            fresh = np.flatnonzero(hit & ~verified)
            verified[fresh] = True
            if spent is not None:
                spent.append(len(fresh))
            fresh = np.setdiff1d(fresh, own_place[own_query == i], assume_unique=True)
            place, best = np.concatenate([place, fresh]), np.concatenate([best, np.einsum("ij,j->i", data[fresh], q_data[i])])
            if len(place) > k:
                keep = _top(place, best, k)
                place, best = place[keep], best[keep]
            if verified.all() or len(place) >= k and width[i] >= z * distance(best.min(), i):
                out_q.append(np.full(len(place), i))
                out_v.append(place)
                out_s.append(best)
            else:
                done[i] = verified, place, best
                width[i] *= WIDER
                going.append(i)
        active = np.array(going, dtype=np.int64)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _top(place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return keep if len(keep) == k else keep[np.lexsort((place[keep], -score[keep]))[:k]]


def matcher(k: int):
    return lambda q_ids, q_data, ids, data: search_tile(q_ids, q_data, ids, data, k)


def approximate_top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by inner product in double precision."""
    return nearest(vectors, F.col("vec_id") % every == 0, k, matcher(k), "double", zero=False)
