"""Fuzzy name lookup by the ratio of matching blocks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFF = 0.55
MOST = 1000  # queries of one call


def close_names(queries: list[str], names: DataFrame, n: int = 1, cutoff: float = CUTOFF, name: str = "name") -> DataFrame:
    """query, name, score, place: the n best names of each query at the cutoff or above, ties by name.

    Texts are compared trimmed and in lower case; blank ones match nothing. The
    queries are a short list; the names stay distributed, each task keeps the n
    best of its own, and a window picks among those.
    """
    asked = sorted({q for q in queries if q and q.strip()})
    if len(asked) > MOST:
        raise ValueError(f"more than {MOST} queries; ask in parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, list[tuple[float, str]]] = {q: [] for q in asked}
        match = SequenceMatcher(None)
        for b in batches:
            for q in asked:
                match.set_seq2(q.strip().lower())
                for x in b["name"]:
                    match.set_seq1(x.strip().lower())
                    if match.real_quick_ratio() >= cutoff and match.quick_ratio() >= cutoff and (r := match.ratio()) >= cutoff:
                        best[q].append((-r, x))
                best[q] = sorted(best[q])[:n]
        yield pd.DataFrame([(q, x, -r) for q, found in best.items() for r, x in found], columns=["query", "name", "score"])

    known = names.select(F.col(name).alias("name")).where("trim(name) <> ''").distinct()
    found = known.mapInPandas(run, "query string, name string, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "name")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
