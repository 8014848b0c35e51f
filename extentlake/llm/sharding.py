"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in source blocks.  A uniform permutation of all rows sends from block i to shard j a number
of rows that follows the multivariate hypergeometric law; the matrix of these numbers is drawn on the
driver from the block counts alone (blocks x shards integers, the block count being bounded).  Each
block is then permuted by itself and dealt out by its row of the matrix, the rows are exchanged, and
each shard is permuted again.  The result is a uniform permutation with shards that differ by at most
one row.

The rows are first written with a number each.  All randomness comes from hashes of that number, the row's key and a seed, so
a task that runs again after the loss of an executor makes the same rows, and equal rows are spread like others, over blocks,
shards and slots.  Both permutations are done in cells of bounded expected size: a row's slot is the rows in the cells
before plus its rank in its cell.  No task holds a shard, whatever keys repeat.

Null keys, null texts, very long texts and repeated rows are rows like others.  Ties of hashes are broken by the row's number.
An empty table gives an empty one.  Columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

#: Source blocks, and cells of a shard.  The driver reads one count per block and broadcasts one row
#: per block and per cell, whatever the input's size; a block or cell is sorted in one task, with spill.
BLOCKS, CELLS = 1 << 12, 1 << 10


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """How many rows each block sends to each shard, drawn as a uniform permutation of all rows would."""
    rng = np.random.default_rng(seed)
    left = np.array(sizes, dtype=np.int64)
    if sum(counts) != left.sum():
        raise ValueError("the shard sizes must add up to the rows")
    matrix = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(counts):
        rest, need = int(left.sum()), int(n)
        for j in range(len(sizes) - 1):
            # Of the places that are left, so many are shard j's.
            own = int(left[j])
            matrix[i, j] = _hypergeometric(rng, own, rest - own, need)
            rest -= own
            need -= int(matrix[i, j])
        matrix[i, -1] = need
        left -= matrix[i]
    return matrix


#: Urns up to this size are drawn from by numpy, which takes no more than 1e9 of a kind.
URN = 500_000_000
#: Standard deviations around the mode that a draw from a larger urn is chosen from; what lies beyond is below 1e-30.
REACH = 12


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int, urn: int = URN) -> int:
    """One draw by the hypergeometric law, at any size."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad <= urn:
        return int(rng.hypergeometric(good, bad, draws))
    # The law's own terms by the ratios of neighbours, outwards from the mode.
    n = good + bad
    mode = (draws + 1) * (good + 1) // (n + 2)
    reach = REACH * (int((draws * (good / n) * (bad / n) * ((n - draws) / (n - 1))) ** 0.5) + 2)
    low, high = max(0, draws - bad, mode - reach), min(draws, good, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(step)))
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], "right"))


def shuffle(
    df: DataFrame,
    shards: int = 8,
    *,
    key: list[str],
    seed: int = 0,
    blocks: int = BLOCKS,
    cells: int = CELLS,
) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (0, 1, ... in each shard): a uniform shuffle
    into shards whose row counts differ by at most one.

    ``key`` names columns that the order depends on, beside the rows' numbers.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    row = fresh(df, "_row")
    df = written(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    key = [*key, row]
    block, cell, order, rank, ends_, shard_, cell_, before_ = (
        fresh(df, c) for c in ("_block", "_cell", "_order", "_rank", "_ends", "_in_shard", "_in_cell", "_before")
    )

    def rnd(salt: str) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(salt), *key)

    placed = df.withColumn(block, F.pmod(rnd("block"), F.lit(blocks)).cast("int"))
    found = {r[block]: r["n"] for r in placed.groupBy(block).agg(F.count("*").alias("n")).collect()}
    counts = [found.get(b, 0) for b in range(blocks)]
    total = sum(counts)
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    ends = np.cumsum(communication_matrix(counts, sizes, seed), axis=1)
    deal = spark.createDataFrame([(b, ends[b].tolist()) for b in range(blocks)], f"{block} int, {ends_} array<long>")

    # Permute each block and deal it out by its row of the matrix.
    local = Window.partitionBy(block).orderBy(order, *key)
    dealt = (
        placed.withColumn(order, rnd("local"))
        .withColumn(rank, F.row_number().over(local))
        .join(F.broadcast(deal), block)
        .withColumn("shard", F.size(F.filter(ends_, lambda e: e < F.col(rank))).cast("int"))
        .drop(ends_, rank, order, block)
    )

    # Exchange and permute each shard: cells in the order of a random key, and ranks inside a cell.
    width = (1 << 62) // cells
    spread = dealt.withColumn(order, F.pmod(rnd("again"), F.lit(width * cells))).withColumn(
        cell, F.expr(f"cast({order} div {width} as int)")
    )
    filled = spread.groupBy("shard", cell).agg(F.count("*").alias("n"))
    before = filled.select(
        F.col("shard").alias(shard_),
        F.col(cell).alias(cell_),
        (F.sum("n").over(Window.partitionBy("shard").orderBy(cell)) - F.col("n")).alias(before_),
    )
    inside = F.row_number().over(Window.partitionBy("shard", cell).orderBy(order, *key)) - 1
    return (
        spread.withColumn(rank, inside)
        .join(F.broadcast(before), (F.col("shard") == F.col(shard_)) & (F.col(cell) == F.col(cell_)))
        .withColumn("slot", (F.col(before_) + F.col(rank)).cast("long"))
        .drop(order, cell, rank, shard_, cell_, before_, row)
    )
