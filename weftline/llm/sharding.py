"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows fall into blocks by a hash of their content. How many rows block b sends to shard s is drawn exactly, as if all rows
were permuted at random: a multivariate hypergeometric draw per block from what is left of each shard. Rows are permuted
inside their block, dealt out by the matrix, and permuted again inside their shard. All rows of a shard never meet in one
task: the second permutation works in cells of a shard, whose first slots come from the cells' counts.

The main path is DataFrame functions only. Rows are dealt once and written with their shard; all counts come from that table
and the one before it. The driver sees the counts of the blocks and of the cells; there is one block for BLOCK_ROWS rows and
one cell for CELL_ROWS rows of a shard, so that a sort never holds more than about so many rows. Blocks and orders are
functions of the rows, so a task that runs again makes the same rows.

Defined results: null keys and texts hash as such; equal rows are interchangeable and keep their number; an empty table
gives an empty table; extra columns are carried, own columns start with `_s_`.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stash

#: Rows of a block and of a cell, about; the least number of blocks and of cells of a shard.
BLOCK_ROWS, CELL_ROWS, BLOCKS, CELLS = 4_000_000, 1_000_000, 1024, 64


def _rest(n: int) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        if total + term / (2 * k + 1) == total:
            return total
        total, k = total + term / (2 * k + 1), k + 1


def _binomial(x: int, n: int, p: float, q: float) -> float:
    """Logarithm of the binomial probability by its saddle point (Loader 2000): its relative error does not grow with n."""
    if x in (0, n):
        return n * (math.log1p(-p) if p < q else math.log(q)) if x == 0 and n else n * (math.log1p(-q) if q < p else math.log(p)) if n else 0.0
    return _rest(n) - _rest(x) - _rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among `drawn` of good + bad, by inversion outwards from the mode."""
    low, high, total = max(0, drawn - bad), min(good, drawn), good + bad
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    share, other = drawn / total, (total - drawn) / total
    p = math.exp(_binomial(mode, good, share, other) + _binomial(drawn - mode, bad, share, other) - _binomial(drawn, total, share, other))
    u, up, down, at_up, at_down = rng.random() - p, p, p, mode, mode
    while u >= 0 and (at_up < high or at_down > low):
        if at_up < high:
            up *= (good - at_up) * (drawn - at_up) / ((at_up + 1) * (bad - drawn + at_up + 1))
            at_up += 1
            u -= up
            if u < 0:
                return at_up
        if at_down > low:
            down *= at_down * (bad - drawn + at_down) / ((good - at_down + 1) * (drawn - at_down + 1))
            at_down -= 1
            u -= down
            if u < 0:
                return at_down
    return mode


def matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each block to each shard: row sums are counts, column sums are sizes."""
    rng, left, rows = random.Random(seed), list(sizes), []
    for n in counts:
        row, rest = [], sum(left)
        for s, k in enumerate(left):
            x = hypergeometric(rng, k, rest - k, n) if n else 0
            row.append(x)
            n, rest = n - x, rest - k
            left[s] -= x
        rows.append(row)
    return rows


def shard(df: DataFrame, keys: list[str], shards: int, seed: int = 0, blocks: int = BLOCKS, cells: int = CELLS) -> DataFrame:
    """df with `_s_shard` (sizes differ by one at most) and `_s_slot` (a random order of each shard, gapless from 0). df is read once; `blocks` and `cells` are the least numbers."""
    hashed = lambda salt: F.xxhash64(F.lit(f"{salt}:{seed}"), *[F.col(f"`{k}`") for k in keys])
    table = stash(df.withColumns({"_s_first": hashed("first"), "_s_second": hashed("second")}), "rows")
    n = table.count()
    blocks, cells = max(blocks, n // BLOCK_ROWS), max(cells, n // shards // CELL_ROWS)
    rows = table.withColumn("_s_block", F.pmod(hashed("block"), F.lit(blocks)).cast("int"))
    counts = [0] * blocks
    for r in rows.groupBy("_s_block").count().collect():
        counts[r["_s_block"]] = r["count"]
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    bounds = [list(accumulate(row)) for row in matrix(counts, sizes, seed)]
    spark = df.sparkSession
    plan = spark.createDataFrame([(b, row) for b, row in enumerate(bounds)], "_s_block int, _s_bounds array<bigint>")
    local = Window.partitionBy("_s_block").orderBy("_s_first", "_s_second", *[F.col(f"`{k}`") for k in keys])
    ranked = rows.withColumn("_s_rank", F.row_number().over(local)).join(F.broadcast(plan), "_s_block")
    ranked = ranked.withColumn("_s_shard", F.size(F.filter("_s_bounds", lambda b: b < F.col("_s_rank"))))
    # ranks differ inside a block, so hashing them in spreads equal rows over a shard and its cells
    again = F.xxhash64(F.lit(f"again:{seed}"), "_s_second", "_s_block", "_s_rank")
    ranked = ranked.withColumn("_s_again", again).withColumn("_s_cell", F.pmod(F.shiftright("_s_again", 7), F.lit(cells)).cast("int"))
    dealt = stash(ranked.drop("_s_bounds", "_s_first", "_s_second"), "dealt")
    discard(table)
    held = {(r["_s_shard"], r["_s_cell"]): r["count"] for r in dealt.groupBy("_s_shard", "_s_cell").count().collect()}
    starts = [(s, c, at) for s in range(shards) for c, at in enumerate(accumulate([held.get((s, c), 0) for c in range(cells)], initial=0)) if c < cells]
    start = spark.createDataFrame(starts, "_s_shard int, _s_cell int, _s_start bigint")
    inner = Window.partitionBy("_s_shard", "_s_cell").orderBy("_s_again", "_s_block", "_s_rank")
    out = dealt.withColumn("_s_in", F.row_number().over(inner)).join(F.broadcast(start), ["_s_shard", "_s_cell"])
    return out.withColumn("_s_slot", F.col("_s_start") + F.col("_s_in") - 1).select(*[F.col(f"`{c}`") for c in df.columns], "_s_shard", "_s_slot")
