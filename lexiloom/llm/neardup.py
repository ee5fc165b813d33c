"""Groups of sentences that differ by small edits, by a token-group matrix.

Two sentences are linked if the distinct words in both are at least ``SHARE`` of the distinct words in at least one of them,
that is of their union. Sentences with the same word set form one class; classes that share their rarest words are neighbours, and
``GROUP`` neighbours at most form a group, which stores the union of its members' tokens.

A link of classes a and b with na <= nb words needs an overlap of SHARE * nb at least, so each of them lacks at most
n - need(n) of its own words, and both hold two common words among their n - need(n) + 2 rarest ones. The matrix therefore
stores, for each group, the pairs of such words that its members hold. A class looks its own pairs up among classes of fitting size of which enough
words follow the pair, which names candidate groups; of these only such are opened whose token union bounds the overlap high enough, and their members are then compared word by
word. Texts of more than ``LONG`` distinct words, whose pairs would be many, and those they can be linked with are looked up by one word of the
n - need(n) + 1 rarest: the same proof, so nothing is lost either way.

Copies never multiply the search: it runs over classes, and only the caller who needs row pairs expands them.

Defined results: null sentences and sentences without a word take no part; repeated rows fall into one class; the order of
words, case and apostrophes don't matter; an empty table gives empty results; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

SHARE_NUM, SHARE_DEN = 7, 10
GROUP_BITS = 3
GROUP = 1 << GROUP_BITS
#: Distinct words up to which a class is looked up by pairs of words.
LONG = 200
#: Words whose rank is broadcast: those that make up a HEAVY-th of all words or more, hence at most so many; none longer than WIDEST.
HEAVY, WIDEST = 1 << 18, 40
#: Rows of one class that one task pairs with rows of another.
BLOCK = 1000
#: Classes that hold a HOT-th of all rows or more, hence at most so many, are joined by broadcast, so that copies never meet in one task.
HOT = 4096


def words(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased, after apostrophes are dropped."""
    plain = text
    for mark in "'’‘":
        plain = F.replace(plain, F.lit(mark), F.lit(""))
    # lower-cased run by run: letters such as the Kelvin sign, whose lower case is ASCII, are in none
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))


def need(n: Column) -> Column:
    """The least overlap that links a class of n words with any other."""
    return F.floor((n * SHARE_NUM + SHARE_DEN - 1) / SHARE_DEN).cast("int")


def linked(both: Column, n: Column, other: Column) -> Column:
    """Whether an overlap is the share of the union of two sets of n and other words."""
    return both * (SHARE_NUM + SHARE_DEN) >= (n + other) * SHARE_NUM


def classes(rows: DataFrame, by: str, row_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members: by, row_id, cls; classes: cls, toks): rows with the same word set share a class.

    toks are the class's words as numbers in ascending order, the rarest word of all first. cls numbers the classes such that neighbours share
    their rarest words; its high bits, without the last GROUP_BITS, name the class's group. Both are tables of the shared folder.
    """
    rows = rows.where(F.col(text).rlike("[A-Za-z0-9]")).select(F.col(by).alias("by"), F.col(row_id).alias("row_id"), F.sort_array(words(F.col(text))).alias("set"))
    # words hold no line feed, so the text that is hashed stands for (by, set)
    named = materialise(rows.withColumn("key", F.unhex(F.md5(F.concat_ws("\n", "by", F.array_join("set", " "))))), "members")

    # words numbered by how many rows hold them; any order would do, this one leaves the fewest candidates
    counted = named.select("by", F.explode("set").alias("word")).groupBy("by", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = materialise(counted.repartitionByRange("n", "by", "word").sortWithinPartitions("n", "by", "word").withColumn("tok", F.monotonically_increasing_id()), "words")
    total = rank.agg(F.sum("n")).first()[0] or 0
    frequent = (F.col("n") * HEAVY >= total) & (F.length("word") <= WIDEST)

    # frequent words get their number by broadcast, without leaving the class's partition; only the others are sent to theirs
    sets = named.groupBy("key").agg(F.first("by").alias("by"), F.first("set").alias("set"))
    known = sets.select("key", "by", F.explode("set").alias("word")).join(F.broadcast(rank.where(frequent).select("by", "word", "tok")), ["by", "word"], "left")
    base = materialise(known.groupBy("key").agg(F.first("by").alias("by"), F.collect_list("tok").alias("toks"), F.collect_list(F.when(F.col("tok").isNull(), F.col("word"))).alias("rest")), "sets")
    seldom = base.select("key", "by", F.explode("rest").alias("word")).join(rank.where(~frequent).select("by", "word", "tok"), ["by", "word"])
    full = base.join(seldom.groupBy("key").agg(F.collect_list("tok").alias("more")), "key", "left")
    full = full.select("key", F.array_sort(F.concat("toks", F.coalesce("more", F.array().cast("array<bigint>")))).alias("toks"))

    order = [*(F.get("toks", F.lit(i)) for i in range(3)), F.col("key")]
    placed = full.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("cls", F.monotonically_increasing_id())
    placed = materialise(placed, "classes")
    return materialise(with_class(named, placed.select("key", "cls"), "key").select("by", "row_id", "cls"), "rows"), placed.select("cls", "toks")


def with_class(rows: DataFrame, classes: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row per key; the rows of hot keys stay where they are."""
    total = rows.count()
    hot = F.broadcast(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT >= F.greatest(F.lit(total), F.lit(HOT * BLOCK))).select(key))
    few = rows.join(hot, key, "left_semi").join(F.broadcast(classes.join(hot, key)), key, how)
    return few.unionByName(rows.join(hot, key, "left_anti").join(classes, key, how))


def groups(cls: DataFrame) -> DataFrame:
    """grp, own (cls, toks of its classes), union, least (words of its smallest class)."""
    grouped = cls.groupBy(_group("cls").alias("grp")).agg(F.collect_list(F.struct("cls", "toks")).alias("own"), F.min(F.size("toks")).alias("least"))
    return grouped.withColumn("union", F.array_distinct(F.flatten("own.toks")))


def _group(cls: str) -> Column:
    return F.shiftright(cls, GROUP_BITS)


def matrix(cls: DataFrame) -> DataFrame:
    """key, cls, n, most: the words or pairs of words, hashed, by which a class of n words is found, and the most common words there
    can be if none stands before or between them."""
    n = F.col("n")
    sized = cls.select("cls", F.size("toks").alias("n"), "toks").where("n > 1")
    rarest = lambda m: F.slice("toks", 1, n - need(n) + m).alias("lead")
    # each word with its place, then those after it: exploded one after the other, which Spark compiles
    first = sized.where(n <= LONG).select("cls", "n", rarest(2)).select("cls", "n", "lead", F.posexplode("lead").alias("i", "x"))
    pairs = first.select("cls", "n", "i", "x", F.posexplode(F.slice("lead", F.col("i") + 2, n)).alias("k", "y"))
    pairs = pairs.select(F.xxhash64("x", "y").alias("key"), "cls", "n", (n - F.col("i") - F.col("k")).alias("most"))
    # a class that can be linked with a long one has need(LONG + 1) words at least
    single = sized.where(n >= need(F.lit(LONG + 1))).select("cls", "n", rarest(1)).select("cls", "n", F.posexplode("lead").alias("i", "x"))
    return pairs.unionByName(single.select(F.xxhash64("x").alias("key"), "cls", "n", (n - F.col("i")).alias("most")))


def links(cls: DataFrame) -> DataFrame:
    """a, b: the linked pairs of different classes, a the one with fewer words (of equal ones the lower number)."""
    m = matrix(cls)
    # one shuffle serves both sides; of two classes the smaller asks
    n, other = F.col("q.n"), F.col("g.n")
    fits = (n * SHARE_DEN >= other * SHARE_NUM) & ((n < other) | ((n == other) & (F.col("q.cls") < F.col("g.cls"))))
    # of the first words that two classes share, those that follow have to make up the rest of the overlap
    reach = linked(F.least("q.most", "g.most"), n, other)
    # the scan's size says nothing about that of the keys, so neither side may be broadcast by it
    hits = m.alias("q").join(m.alias("g").hint("merge"), (F.col("q.key") == F.col("g.key")) & fits & reach)
    hits = hits.select(F.col("q.cls").alias("cls"), _group("g.cls").alias("grp")).repartition("cls").distinct()

    # bound each class's overlap with the group's union; open the groups that qualify
    n = F.size("toks")
    asking = hits.join(cls, "cls").join(groups(cls), "grp")
    opened = asking.where(linked(F.size(F.array_intersect("union", "toks")), n, F.greatest(n, F.col("least"))))
    member = opened.select("cls", "toks", F.explode("own").alias("m"))
    larger = (F.size("m.toks") > n) | ((F.size("m.toks") == n) & (F.col("m.cls") > F.col("cls")))
    found = member.where(larger).where(linked(F.size(F.array_intersect("m.toks", "toks")), n, F.size("m.toks")))
    return found.select(F.col("cls").alias("a"), F.col("m.cls").alias("b"))


def components(cls: DataFrame, pairs: DataFrame, *, rounds: int = 40) -> DataFrame:
    """cls, label: the least class each one is connected with, by rounds of large-star and small-star.

    Each round's edges are a table of the shared folder. Rounds end when no edge changes (their number grows with
    the logarithm of the longest chain); not getting there within ``rounds`` is an error, never a partial result.
    """
    edges = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large-star: every neighbour above u goes to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and every neighbour below it go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return cls.select("cls").join(edges.select(F.col("u").alias("cls"), "v"), "cls", "left").select("cls", F.coalesce("v", "cls").alias("label"))
        before = state
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def row_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """by, rec_id_a, rec_id_b: linked rows, of one class or of two linked ones, each pair once.

    A class of many rows is paired block by block, so no task gets more than BLOCK rows of each side.
    """
    count = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    blocks = count.select("cls", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    large = blocks.where("k > 1").select("cls", "k")
    rows = with_class(members, large, "cls", "left").select("by", "row_id", "cls", F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("k")).cast("int"), F.lit(0)).alias("at"))
    a = rows.select("by", F.col("cls").alias("a"), F.col("at").alias("i"), F.col("row_id").alias("x"))
    b = rows.select(F.col("cls").alias("b"), F.col("at").alias("j"), F.col("row_id").alias("y"))

    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    copies = blocks.where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), "k", each("k").alias("i"))
    copies = copies.select("a", "b", "i", F.explode(F.sequence("i", F.col("k") - 1)).alias("j"))
    k = lambda own: large.select(F.col("cls").alias(own), F.col("k").alias(f"k_{own}"))
    other = pairs.join(k("a"), "a", "left").join(k("b"), "b", "left").select("a", "b", F.coalesce("k_a", F.lit(1)).alias("k_a"), F.coalesce("k_b", F.lit(1)).alias("k_b"))
    other = other.select("a", "b", "k_b", each("k_a").alias("i")).select("a", "b", "i", each("k_b").alias("j"))
    found = copies.unionByName(other).join(a, ["a", "i"]).join(b, ["b", "j"])
    once = (F.col("a") != F.col("b")) | (F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))
    return found.where(once).select("by", F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b"))
