"""Second orders of a fused list: by similarity, and by marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAMBDA = 0.7


def by_cosine(fused: DataFrame, similarity: DataFrame, depth: int = 50) -> DataFrame:
    """The first `depth` of each list by similarity (query_id, edge_id, score), ties and the tail in fused order."""
    joined = fused.join(similarity.select("query_id", "edge_id", "score"), ["query_id", "edge_id"], "left")
    head = F.when(F.col("rank") <= depth, F.round(F.coalesce("score", F.lit(-1.0)), 9))
    order = Window.partitionBy("query_id").orderBy((F.col("rank") > depth).cast("int"), head.desc(), "rank")
    return joined.withColumn("rank", F.row_number().over(order))


def _select(k: int, weight: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank", kind="stable").reset_index(drop=True)
        if len(g) > 1 and k > 1 and g["vector"].notna().all():
            m = np.array(g["vector"].tolist(), dtype=np.float64)
            norm = np.linalg.norm(m, axis=1)
            m = m / np.where(norm > 0, norm, 1)[:, None]
            rel = 1 - np.arange(len(g)) / len(g)
            chosen, seen = [0], m @ m[0]
            while len(chosen) < min(k, len(g)):
                s = weight * rel - (1 - weight) * seen
                s[chosen] = -np.inf
                best = int(np.argmax(s))
                chosen.append(best)
                seen = np.maximum(seen, m @ m[best])
            g = g.iloc[chosen].reset_index(drop=True)
        g = g.head(k)
        return pd.DataFrame({"query_id": g["query_id"], "edge_id": g["edge_id"], "rank": np.arange(1, len(g) + 1, dtype=np.int32)})

    return run


def mmr(fused: DataFrame, vectors: DataFrame, k: int, weight: float = LAMBDA) -> DataFrame:
    """Greedy marginal relevance over a list (at most 50 items a query): relevance is 1 - position / length; a list with a fact
    without a vector keeps its order."""
    joined = fused.select("query_id", "edge_id", "rank").join(vectors.select("edge_id", "vector"), "edge_id", "left")
    return joined.groupBy("query_id").applyInPandas(_select(k, weight), "query_id long, edge_id long, rank int")
