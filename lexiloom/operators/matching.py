"""One-to-one matching within small groups, and rows that lack a partner."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def maximum_matching(pairs: list[tuple]) -> dict:
    """left -> right of a matching with as many pairs as possible, by augmenting paths, lefts and rights in ascending order."""
    right_of: dict = {}
    edges: dict = {}
    for a, b in sorted(set(pairs)):
        edges.setdefault(a, []).append(b)
    for start in edges:
        # a path that alternates between free and matched pairs, depth first without recursion
        seen, trail = set(), [(start, iter(edges[start]))]
        path: list[tuple] = []
        while trail:
            a, options = trail[-1]
            for b in options:
                if b in seen:
                    continue
                seen.add(b)
                path.append((a, b))
                if b not in right_of:
                    for x, y in path:
                        right_of[y] = x
                    trail = []
                else:
                    trail.append((right_of[b], iter(edges[right_of[b]])))
                break
            else:
                trail.pop()
                if path:
                    path.pop()
    return {a: b for b, a in right_of.items()}


def block_matching(lefts: dict, rights: dict) -> dict:
    """left -> right of a matching with as many pairs as possible, where a left may take any right of one of its blocks.

    lefts: left -> blocks; rights: block -> rights. Searches for a longer alternating path by breadth, over blocks, so pairs are never written out.
    """
    right_of: dict = {}
    left_of: dict = {}
    for start in sorted(lefts):
        came, seen, queue, found = {}, set(), deque([start]), None
        while queue and found is None:
            a = queue.popleft()
            for block in lefts[a]:
                if block in seen:
                    continue
                seen.add(block)
                for b in rights.get(block, ()):
                    if b in came:
                        continue
                    came[b] = a
                    if b not in left_of:
                        found = b
                        break
                    queue.append(left_of[b])
                if found is not None:
                    break
        while found is not None:
            a = came[found]
            before = right_of.get(a)
            right_of[a], left_of[found] = found, a
            found = before if a != start else None
    return right_of


def match_pairs(pairs: DataFrame, group: list[str], left: str, right: str) -> DataFrame:
    """group, left, right of a maximum one-to-one matching of each group's candidate pairs. For groups bounded by their nature, such as one review's rows."""
    kinds = dict(pairs.dtypes)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = maximum_matching(list(zip(rows[left], rows[right])))
        return pd.DataFrame({**{g: [rows[g].iloc[0]] * len(found) for g in group}, left: list(found), right: list(found.values())})

    own = [*group, left, right]
    return pairs.select(*own).groupBy(*group).applyInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in own))


def match(left: DataFrame, right: DataFrame, group: str, on: list[str]) -> DataFrame:
    """group, left_id, right_id of all rows: matched pairs, and each side's unmatched rows with null for the other.

    left and right have group, the columns of ``on``, and left_id or right_id; pairs may be matched where all of ``on`` agree.
    """
    # rows that agree on ``on`` are a block in which every pair may be matched: the n-th left takes the n-th right. Only groups with
    # an id in several blocks need a search, which holds the group's rows, never its pairs
    block = [group, *on]
    own, other = (side.select(*block, i).distinct().dropna(subset=block) for side, i in ((left, "left_id"), (right, "right_id")))
    several = [side.groupBy(group, i).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(group) for side, i in ((own, "left_id"), (other, "right_id"))]
    mixed = several[0].unionByName(several[1]).distinct()
    numbered = lambda side, i: side.join(mixed, group, "left_anti").withColumn("__n", F.row_number().over(W.partitionBy(*block).orderBy(i)))
    plain = numbered(own, "left_id").join(numbered(other, "right_id"), [*block, "__n"]).select(group, "left_id", "right_id")
    kinds = dict(own.dtypes) | dict(other.dtypes)
    named = F.to_json(F.struct(*on)).alias("__block")
    searched = [side.join(mixed, group, "left_semi").select(group, named, i).groupBy(group) for side, i in ((own, "left_id"), (other, "right_id"))]

    def solve(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        lefts: dict = {}
        rights: dict = {}
        for name, a in zip(mine["__block"], mine.left_id):
            lefts.setdefault(a, []).append(name)
        for name, b in zip(theirs["__block"], theirs.right_id):
            rights.setdefault(name, []).append(b)
        found = block_matching({a: sorted(own) for a, own in lefts.items()}, {name: sorted(own) for name, own in rights.items()})
        where = mine if len(mine) else theirs
        return pd.DataFrame({group: [where[group].iloc[0]] * len(found), "left_id": list(found), "right_id": list(found.values())})

    searched = searched[0].cogroup(searched[1]).applyInPandas(solve, f"{group} {kinds[group]}, left_id {kinds['left_id']}, right_id {kinds['right_id']}")
    done = searched.unionByName(plain)
    lone_left = left.select(group, "left_id").distinct().join(done, [group, "left_id"], "left_anti").withColumn("right_id", F.lit(None).cast(kinds["right_id"]))
    lone_right = right.select(group, "right_id").distinct().join(done, [group, "right_id"], "left_anti").withColumn("left_id", F.lit(None).cast(kinds["left_id"]))
    return done.unionByName(lone_left).unionByName(lone_right)


def without_partner(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys no other row has; null keys have none."""
    return rows.join(others.select(*on).distinct(), on, "left_anti")
