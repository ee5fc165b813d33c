"""Documents as training sequences of a fixed number of tokens, by bin completion.

A document longer than the capacity is divided into full pieces and a rest; everything else stays whole. The items are spread by a hash
over shards of about SHARD items, so no search's size grows with the data; a task packs one shard after another, so their
number doesn't grow without bound either. Within a shard, bins are completed one after another
around the largest item left: fillings are enumerated largest items first, dominated ones are dropped, and the search backtracks
while the bound (bins so far and what the rest needs at least) beats the incumbent, which best-fit decreasing provides. Items of
bins that stay emptier than OPEN of their capacity are packed again, all shards' together, in smaller rounds. A round is the last
if it has one shard, or if it leaves more than RETRY of its items in such bins: their sizes hardly combine, and its bins stand as they are.

Defined results: null and empty texts have no tokens and are in no sequence; repeated rows are separate items; sizes equal to
the capacity fill a bin alone; a text that the tokenizer's pattern can't run over as a whole is tokenized in
blocks of 100,000 characters; an empty table gives no sequence.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, public_vocabulary, slots

CAPACITY = 4096
SHARD = 8192
OPEN = 0.002
RETRY = 0.5
#: Tasks of a round for each slot of the cluster; beyond it a task packs several shards.
TASKS_A_SLOT = 32
#: Fillings tried for a bin at most, steps to find these, and steps of a shard's whole search, after which its incumbent stands.
WIDTH, STEPS, WORK = 4, 3000, 400_000
#: With at most so many items left, the sharper bound is taken and states that led nowhere are remembered.
FEW = 400

# Fixed value: how the byte-level vocabularies cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"
_BLOCK = 100_000


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a vocabulary file, once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    enc = encoding(path)
    try:
        return len(enc.encode_ordinary(text))
    except BaseException as e:  # the pattern's engine gives up on very long runs, not as an Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit)) or len(text) <= _BLOCK:
            raise
        return sum(len(enc.encode_ordinary(text[i : i + _BLOCK])) for i in range(0, len(text), _BLOCK))


def sizes(documents: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of the documents that have any. Only these two columns are read."""
    path = path or public_vocabulary(VOCABULARY)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(t, path) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], schema=schema)

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text != ''")
    return rows.mapInArrow(count, "doc_id long, n_tokens long")


def pieces(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start_token, n_tokens: whole documents, and the full pieces and rest of longer ones."""
    last = F.floor((F.col("n_tokens") - 1) / capacity)
    cut = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * capacity
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start_token"), F.least(F.col("n_tokens") - start, F.lit(capacity)).alias("n_tokens"))


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing."""
    open_bins: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for size in sorted(items, reverse=True):
        at = bisect_right(open_bins, (size, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(size)
        if room > size:
            insort(open_bins, (room - size, b))
    return bins


def least_bins(left: Counter, capacity: int) -> int:
    """Bins that the sizes need at least: their sum, and those over half a capacity one by one."""
    total = sum(s * n for s, n in left.items())
    return max(-(-total // capacity), sum(n for s, n in left.items() if 2 * s > capacity))


def sharper_bound(left: Counter, capacity: int) -> int:
    """The most that any cut k gives: items above capacity - k stand alone, those above half need bins of their own, the rest fill what these leave."""
    sizes = sorted(s for s, n in left.items() for _ in range(n))
    sums = [0, *accumulate(sizes)]
    half = bisect_right(sizes, capacity // 2)
    best = 0
    for k in {0, *sizes[:half]}:
        alone = len(sizes) - max(half, bisect_right(sizes, capacity - k))
        at = len(sizes) - alone
        spare = (at - half) * capacity - (sums[at] - sums[half])
        small = sums[half] - sums[bisect_left(sizes, k)]
        best = max(best, len(sizes) - half + max(0, -(-(small - spare) // capacity)))
    return best


def fillings(left: Counter, order: list[int], room: int, spent: list[int]) -> list[tuple[int, ...]]:
    """Up to WIDTH undominated sets of the sizes left that fit into room, the fullest first.

    order are the sizes left, ascending. Larger sizes are tried first; a set that can't get fuller than the worst one kept is
    not followed; the search ends with an exact filling or after STEPS steps.
    """
    kept: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def extend(rest: int, top: int, chosen: list[int]) -> bool:
        nonlocal steps
        at = min(bisect_right(order, rest), top) - 1
        used = Counter(chosen)
        tried = 0
        while at >= 0 and tried < WIDTH:
            steps += 1
            if steps > STEPS:
                return True
            size = order[at]
            if used[size] < left[size]:
                tried += 1
                chosen.append(size)
                if rest == size:
                    kept.append((0, tuple(chosen)))
                    return True
                if extend(rest - size, at + 1, chosen):
                    return True
                chosen.pop()
            at -= 1
        if not tried and (len(kept) < WIDTH or rest < kept[-1][0]):
            insort(kept, (rest, tuple(chosen)))
            del kept[WIDTH:]
        return False

    extend(room, len(order), [])
    spent[0] += steps
    kept.sort()
    return [f for waste, f in kept if not _dominated(f, waste, left, order)] or [kept[0][1] if kept else ()]


def _dominated(filling: tuple[int, ...], waste: int, left: Counter, order: list[int]) -> bool:
    """Whether a size left out could stand in for one chosen size, or two, and fill the bin further: then that set is as good."""
    if not waste:
        return False
    used = Counter(filling)
    sums = set(filling) | {x + y for i, x in enumerate(filling) for y in filling[i + 1 :]}
    for s in sums:
        at = bisect_right(order, s + waste) - 1
        while at >= 0 and order[at] > s:
            if used[order[at]] < left[order[at]]:
                return True
            at -= 1
    return False


def complete(items: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins for sizes of at most the capacity, by bin completion with bounds."""
    best = best_fit(items, capacity)
    left = Counter(items)
    bound = least_bins(left, capacity)
    order = sorted(left)
    bins: list[list[int]] = []
    # each level: the fillings of its bin not tried yet
    stack: list[list[tuple[int, ...]]] = []
    total, count, spent = sum(items), len(items), [0]
    hopeless: dict[tuple, int] = {}

    def take(bin_: list[int], sign: int) -> None:
        nonlocal total, count
        for size in bin_:
            left[size] -= sign
            total -= sign * size
            count -= sign
            if sign > 0 and not left[size]:
                del order[bisect_right(order, size) - 1]
            elif sign < 0 and left[size] == 1:
                insort(order, size)

    def bounded() -> bool:
        """Whether what is left can't lead to fewer bins than the incumbent."""
        room = len(best) - len(bins)
        if max(-(-total // capacity), 1) >= room:
            return True
        if count > FEW:
            return False
        spent[0] += 4 * count
        state = tuple((s, left[s]) for s in order)
        if hopeless.get(state, 0) >= room or sharper_bound(+left, capacity) >= room:
            return True
        hopeless[state] = room  # it is followed now; when it comes again, it led nowhere
        return False

    descend = True
    while len(best) > bound and spent[0] < WORK:
        if descend and not order:
            if len(bins) < len(best):
                best = [list(b) for b in bins]
            descend = False
            continue
        if descend and bounded():
            descend = False
            continue
        if descend:
            largest = order[-1]
            take([largest], 1)
            options = fillings(left, order, capacity - largest, spent)
            take([largest], -1)
            stack.append([(largest, *f) for f in reversed(options)])
        else:
            if not bins:
                break
            take(bins.pop(), -1)
        while stack and not stack[-1]:
            stack.pop()
            if not bins:
                break
            take(bins.pop(), -1)
        if not stack:
            break
        spent[0] += 1
        chosen = list(stack[-1].pop())
        take(chosen, 1)
        bins.append(chosen)
        descend = True
    return best


def _pack_shard(capacity: int):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        rows = shard.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        by_size: dict[int, list[int]] = {}
        for i in range(len(rows) - 1, -1, -1):
            by_size.setdefault(int(rows.n_tokens[i]), []).append(i)
        number, offset, fill = [0] * len(rows), [0] * len(rows), [0] * len(rows)
        for b, own in enumerate(complete(rows.n_tokens.astype(int).tolist(), capacity)):
            at = 0
            for size in own:
                i = by_size[size].pop()
                number[i], offset[i], fill[i] = b, at, sum(own)
                at += size
        return rows.assign(bin=number, offset=offset, fill=fill)[["shard", "doc_id", "piece", "start_token", "n_tokens", "bin", "offset", "fill"]]

    return pack


_PACKED = "shard long, doc_id long, piece int, start_token long, n_tokens long, bin long, offset long, fill long"
_ITEM = ["doc_id", "piece", "start_token", "n_tokens"]


def sequences(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence, offset, doc_id, piece, start_token, n_tokens: where each piece stands. counted has doc_id and n_tokens.

    sequence is a text, '<round>-<shard>-<bin>'; pieces that fill a sequence alone are '0-<doc>-<piece>'-like and skip the search.
    """
    items = materialise(pieces(counted, capacity), "pieces")
    full = items.where(F.col("n_tokens") == capacity)
    number = F.concat_ws("-", F.lit("0"), "doc_id", "piece", F.monotonically_increasing_id())
    out = [full.select(number.alias("sequence"), F.lit(0).cast("long").alias("offset"), *_ITEM)]
    todo, turn = items.where(F.col("n_tokens") < capacity), 1
    n = todo.count()
    while True:
        shards = max(1, -(-n // SHARD))
        keyed = todo.select(*_ITEM, F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(shards)).alias("shard"))
        # so many tasks are asked for: merged by their few bytes, all shards would be packed by one
        keyed = keyed.repartition(min(shards, TASKS_A_SLOT * slots(counted.sparkSession)), "shard")
        packed = materialise(keyed.groupBy("shard").applyInPandas(_pack_shard(capacity), _PACKED), "packed")
        named = F.concat_ws("-", F.lit(str(turn)), "shard", "bin")
        done = packed if shards == 1 else packed.where(F.col("fill") >= (1 - OPEN) * capacity)
        out.append(done.select(named.alias("sequence"), "offset", *_ITEM))
        if shards == 1:
            break
        rest = packed.where(F.col("fill") < (1 - OPEN) * capacity).select(*_ITEM)
        left = rest.count()
        if left > RETRY * n:
            out[-1] = packed.select(named.alias("sequence"), "offset", *_ITEM)
            break
        todo, n, turn = rest, left, turn + 1
    result = out[0]
    for other in out[1:]:
        result = result.unionByName(other)
    return result
