"""Sequential Elo ratings before each map."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .scan import in_order

START, K = 1500.0, 32.0


def expected(a: float, b: float) -> float:
    return 1 / (1 + 10 ** ((b - a) / 400))


def rate_maps(maps: DataFrame, pool: str | None = None, start: float = START, k: float = K) -> DataFrame:
    """match_id, map, elo_1, elo_2: both teams' ratings before each map.

    ``maps``: match_id, map, ts, team_1_id, team_2_id, result (1 if team 1 won, 0 if
    it lost, 0.5 for a draw, null if unknown, which leaves the ratings). Maps run
    in the order (ts, match_id, map); those of equal time follow one another. Rows
    without both ids give no row.

    The work is sequential between teams that meet, so each pool of teams is one
    ordered scan in one task: ``pool``, or the connected component of who played whom.
    The scan streams; what it remembers is one number for each team of the pool.
    """
    m = maps.where("team_1_id is not null and team_2_id is not null and ts is not null")
    if pool is None:
        m = graph.checkpointed(m.select("match_id", "map", "ts", "team_1_id", "team_2_id", "result"))  # read for who met and for the scan
        m = graph.with_component(m, "team_1_id", "team_2_id", "pool")
        pool = "pool"
    m = m.select(F.col(pool).alias("pool"), "ts", "match_id", "map", "team_1_id", "team_2_id", F.col("result").cast("double").alias("result"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rating: dict = {}
        current: object = rating  # equals no pool
        for b in batches:
            one, two = [], []
            for p, x, y, r in zip(*(b.column(i).to_pylist() for i in (0, 4, 5, 6)), strict=True):
                if p != current:
                    rating, current = {}, p
                e, f = rating.get(x, start), rating.get(y, start)
                one.append(e)
                two.append(f)
                if r is not None and r == r:
                    move = k * (r - expected(e, f))
                    rating[x], rating[y] = e + move, f - move
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(one, pa.float64()), pa.array(two, pa.float64())], ["match_id", "map", "elo_1", "elo_2"])

    schema = ", ".join(f"{c} {t}" for c, t in m.select("match_id", "map").dtypes) + ", elo_1 double, elo_2 double"
    return in_order(m, ["pool"], ["ts", "match_id", "map"], run, schema)


def add_elo(df: DataFrame, ratings: DataFrame) -> DataFrame:
    """team_elo, opponent_elo, elo_gap of player rows that have team_id and team_1_id, by (match_id, map)."""
    first = F.col("team_id") == F.col("team_1_id")
    out = df.join(ratings, ["match_id", "map"], "left")
    out = out.withColumns({"team_elo": F.when(first, F.col("elo_1")).otherwise(F.col("elo_2")), "opponent_elo": F.when(first, F.col("elo_2")).otherwise(F.col("elo_1"))})
    return out.withColumn("elo_gap", F.col("team_elo") - F.col("opponent_elo")).drop("elo_1", "elo_2")
