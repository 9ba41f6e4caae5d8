"""How far each retrieved document lies from the cluster it belongs to, within its query's hits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STARTS, ROUNDS, SEED = 10, 100, 20
SCHEMA = "query_id long, doc_id long, cluster int, distance double, method string, anomaly double"


def _lloyd(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and places of the best of STARTS runs, all run as one array (start, point, centre)."""
    rng, n = np.random.default_rng(SEED), len(x)
    between = ((x[:, None] - x[None]) ** 2).sum(-1)
    chosen = rng.integers(n, size=(STARTS, 1))
    for _ in range(1, k):
        reach = np.cumsum(between[chosen].min(axis=1), axis=1)
        flat = reach[:, -1:] <= 0
        reach = np.where(flat, np.arange(1, n + 1), reach)
        drawn = (reach <= rng.random((STARTS, 1)) * reach[:, -1:]).sum(axis=1, keepdims=True)
        chosen = np.hstack([chosen, np.minimum(drawn, n - 1)])
    centres, where = x[chosen], None
    for _ in range(ROUNDS):
        apart = ((x[None, :, None] - centres[:, None]) ** 2).sum(-1)
        now = apart.argmin(-1)
        if where is not None and (now == where).all():
            break
        where = now
        member = np.eye(k)[where]
        held = member.sum(1)[..., None]
        centres = np.where(held > 0, np.einsum("snk,nd->skd", member, x) / np.maximum(held, 1), centres)
    spread = ((x[None] - np.take_along_axis(centres, where[..., None], 1)) ** 2).sum((1, 2))
    best = int(spread.argmin())
    return centres[best], where[best]


def distances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """Cluster, distance to its centre and method: none for one point, the common mean below four."""
    n = len(x)
    if n < 2:
        return np.zeros(n, int), np.zeros(n), "singleton"
    if n < 4:
        return np.zeros(n, int), np.linalg.norm(x - x.mean(0), axis=1), "centroid_distance"
    centres, where = _lloyd(x, max(2, min(3, n // 2)))
    return where, np.linalg.norm(x - centres[where], axis=1), "kmeans"


def _anomaly(d: np.ndarray) -> np.ndarray:
    """Robust z of the distances (0 without spread), squashed to 0..1."""
    spread = 1.4826 * np.median(np.abs(d - np.median(d)))
    return 1 - np.exp(-np.maximum((d - np.median(d)) / spread, 0) / 2) if len(d) > 1 and spread > 0 else np.zeros(len(d))


def cluster_anomaly(hits: DataFrame) -> DataFrame:
    """``hits`` (query_id, doc_id, embedding): the hits of one query make one group, which its k bounds.

    Rows without a vector are not measured and left out; other columns are not looked at.
    """

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        where, d, method = distances(np.array(rows["embedding"].tolist(), dtype=float))
        return pd.DataFrame({"query_id": rows["query_id"], "doc_id": rows["doc_id"], "cluster": where.astype(np.int32), "distance": d.round(6), "method": method, "anomaly": _anomaly(d).round(6)})

    return hits.where("embedding is not null").select("query_id", "doc_id", "embedding").groupBy("query_id").applyInPandas(group, SCHEMA)
