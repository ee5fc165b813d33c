"""A sample whose category shares follow given targets, by swap repair over category signatures.

A row's signature is the row of the target table it falls in, or none; so there are never more signatures than targets
plus one, and the search runs over their counts on the driver whatever the size of the pool. It starts from a random
floor-satisfying allocation, moves counts between signatures while that lowers the total deviation from the targets, and
then draws that many rows of each signature at random: every row has a hashed place, a histogram of places per signature
gives the bucket in which the cut falls, and only that bucket's rows are put in order.

Defined results: rows with a null category are no part of the pool; an empty pool gives an empty sample and reports every
target with a floor as short; a category given twice in the targets is an error; ties in a place are broken by the key.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096
#: Targets are a small table by contract; more are refused rather than broadcast.
MAX_TARGETS = 10_000


@dataclass
class Target:
    category: tuple
    share_pm: int
    floor: int
    available: int = 0

    def quota(self, size: int) -> int:
        """share_pm of the sample, rounded up."""
        return -(-self.share_pm * size // 1000)

    def wanted(self, size: int) -> int:
        return max(self.floor, self.quota(size))


def apportion(targets: list[Target], size: int) -> list[int]:
    """Counts nearest to the shares that add up to size (largest remainders), before floors."""
    total = sum(t.share_pm for t in targets) or 1
    exact = [t.share_pm * size / total for t in targets]
    counts = [int(x) for x in exact]
    for i in sorted(range(len(targets)), key=lambda i: (counts[i] - exact[i], i))[: max(0, size - sum(counts))]:
        counts[i] += 1
    return counts


def allocate(targets: list[Target], others: int, size: int, seed: int) -> list[int]:
    """Rows to draw of each target's signature and, last, of rows outside all targets.

    Deviation is the sum of the distances from the apportioned shares; floors are held as far as the pool has rows.
    """
    rng = random.Random(seed)
    aim = [*apportion(targets, size), 0]
    room = [*(t.available for t in targets), others]
    floor = [*(min(t.floor, t.available) for t in targets), 0]
    size = min(size, sum(room))
    take = list(floor)
    while sum(take) > size:  # floors alone may be too many for a tiny sample
        i = max(range(len(take)), key=lambda i: (take[i] - aim[i], i))
        floor[i] -= 1
        take[i] -= 1
    left = size - sum(take)
    spare = [r - t for r, t in zip(room, take)]
    while left:  # the random start: spread the rest in chunks over what the pool still has
        i = rng.choices(range(len(take)), weights=spare)[0]
        n = min(spare[i], max(1, left // 2))
        take[i], spare[i], left = take[i] + n, spare[i] - n, left - n
    while True:  # repair: move rows from the signature most above its aim to the one most below it
        give = max((i for i in range(len(take)) if take[i] > max(floor[i], aim[i])), key=lambda i: take[i] - max(floor[i], aim[i]), default=None)
        get = max((i for i in range(len(take)) if take[i] < min(room[i], aim[i])), key=lambda i: min(room[i], aim[i]) - take[i], default=None)
        if give is None or get is None:
            break
        n = min(take[give] - max(floor[give], aim[give]), min(room[get], aim[get]) - take[get])
        take[give], take[get] = take[give] - n, take[get] + n
    return take


def load_targets(targets: DataFrame, columns: list[str]) -> list[Target]:
    """The target table (columns, share_pm, min_rows), which is small and checked to be."""
    rows = targets.select(*columns, "share_pm", "min_rows").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    found = [Target(tuple(r[: len(columns)]), r["share_pm"] or 0, r["min_rows"] or 0) for r in rows]
    if len({t.category for t in found}) < len(found):
        raise ValueError("a category has two targets")
    return sorted(found, key=lambda t: tuple(map(str, t.category)))


def sign(pool: DataFrame, targets: list[Target], columns: list[str]) -> DataFrame:
    """pool with sig: the number of its target, or the number of targets where none applies."""
    names = [f"__{c}" for c in columns]
    spark = pool.sparkSession
    schema = ", ".join(f"{n} string" for n in names) + ", sig int"
    table = spark.createDataFrame([(*t.category, i) for i, t in enumerate(targets)], schema)
    on = [pool[c].eqNullSafe(F.col(n)) for c, n in zip(columns, names)]
    return pool.join(F.broadcast(table), on, "left").drop(*names).withColumn("sig", F.coalesce("sig", F.lit(len(targets))))


def fill(signed: DataFrame, targets: list[Target]) -> int:
    """Counts of the pool per target; returns the number of rows outside all of them."""
    counts = {r["sig"]: r["n"] for r in signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, t in enumerate(targets):
        t.available = counts.get(i, 0)
    return counts.get(len(targets), 0)


def draw(signed: DataFrame, take: list[int], key: Column, seed: int) -> DataFrame:
    """take[sig] rows of each signature, at random; key tells rows apart and decides ties."""
    placed = signed.withColumn("__place", F.xxhash64(F.lit(seed), key)).withColumn("__bucket", F.pmod("__place", F.lit(BUCKETS)).cast("int"))
    # at most (targets + 1) * BUCKETS sums, in Spark
    sums = placed.groupBy("sig", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("sig").orderBy("__bucket")) - F.col("n")
    wanted = signed.sparkSession.createDataFrame(list(enumerate(take)), "sig int, take long")
    cut = sums.withColumn("before", before).join(F.broadcast(wanted), "sig").where("before < take")
    cut = cut.select("sig", "__bucket", "n", (F.col("take") - F.col("before")).alias("rest"))
    kept = placed.join(cut, ["sig", "__bucket"])
    whole = kept.where("n <= rest")
    part = kept.where("n > rest").withColumn("__rank", F.row_number().over(W.partitionBy("sig").orderBy("__place", key))).where("__rank <= rest").drop("__rank")
    return whole.unionByName(part).drop("__place", "__bucket", "n", "rest")
