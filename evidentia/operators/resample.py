"""Bootstrap resamples of exactly as many rows as there are, drawn side by side.

A resample is a multinomial draw.  Rows lie in cells by the hash of their key, and the number of draws
that fall into a cell is found by halving: at each node of a binary tree over the cells a binomial draw,
seeded by resample and node, says how many of the node's draws go left.  Every task finds its own cell's
numbers in that way, all agree, and the sum over all cells is the number of rows.  Within its cell a task
draws rows in the order of their keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.storage import written

#: Rows that a cell is to have, and cells at most; their sizes are all that every task gets.
CELL_ROWS, MOST_CELLS = 4096, 1 << 20


def _halved(before: np.ndarray, cell: int, resample: int, seed: int) -> int:
    """Draws of a resample that fall into a cell; ``before`` has the rows before each cell, and all at its end."""
    low, high, draws, node = 0, len(before) - 1, int(before[-1]), 1
    while high - low > 1 and draws:
        middle = (low + high) // 2
        whole, left = before[high] - before[low], before[middle] - before[low]
        rng = np.random.default_rng((seed, resample, node))
        to_left = int(rng.binomial(draws, left / whole)) if 0 < left < whole else (draws if left else 0)
        if cell < middle:
            high, draws, node = middle, to_left, 2 * node
        else:
            low, draws, node = middle, draws - to_left, 2 * node + 1
    return draws


def resampled(rows: DataFrame, key: str, resamples: int, seed: int = 20) -> DataFrame:
    """``rows`` with ``times``, an array of how often each resample has the row; written.

    Rows that repeat a key are told apart by their order alone, which is then that of their digests.  A null key
    is a key.  Without rows there are none.
    """
    spark = rows.sparkSession
    n = rows.count()
    cells = 1
    while cells * CELL_ROWS < n and cells < MOST_CELLS:
        cells *= 2
    named = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(cells)).cast("int"))
    named = written(named.withColumn("own", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])), 256)), "celled")
    sizes = np.zeros(cells, dtype=np.int64)
    for r in named.groupBy("cell").count().collect():  # at most MOST_CELLS numbers
        sizes[r["cell"]] = r["count"]
    before = spark.sparkContext.broadcast(np.concatenate(([0], np.cumsum(sizes))))

    def drawn(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values([key, "own"], kind="stable", na_position="first")
        number, size = int(cell["cell"].iloc[0]), len(cell)
        counts = np.empty((resamples, size), dtype=np.int32)
        for r in range(resamples):
            rng = np.random.default_rng((seed, r + 1, 0, number))
            counts[r] = np.bincount(rng.integers(size, size=_halved(before.value, number, r + 1, seed)), minlength=size)
        return cell.drop(columns=["cell", "own"]).assign(times=list(counts.T))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", times array<int>"
    return written(named.groupBy("cell").applyInPandas(drawn, schema), "resampled")


def exploded(rows: DataFrame) -> DataFrame:
    """One row for each resample (``model``, from 1) that has the row, ``times`` times."""
    names = [F.col(f"`{c}`") for c in rows.columns if c != "times"]
    each = rows.select(*names, F.posexplode("times").alias("at", "times")).where("times > 0")
    return each.withColumn("model", F.col("at") + 1).drop("at")

