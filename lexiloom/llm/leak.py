"""Evaluation passages inside training text, by a distributed positional inverted index.

Index: the documents are cut into blocks of about BLOCK words; each block is one row with its vocabulary and, per term, the
ascending positions of all its postings (delta-coded). Blocks are built where the documents are read, so indexing shuffles nothing, and
every word of every document is stored. A document's positions are set apart from the next one's by a gap, so no phrase or
window reaches over.

Search: the query terms (a bounded table, checked) go to every block. For each passage the lists of its rarest terms in that block
are shifted by their offsets and intersected, rarest first; what remains are exact alignments. Proximity matches take the
rarest terms' positions as anchors and count the other terms in the windows around them.

Words are runs of ASCII letters and digits of the NFKC text, lower-cased, after invisible format characters and apostrophes are
dropped. Defined results: null and wordless documents have no postings; passages with fewer words than asked match nothing; repeated
documents are found each; queries of the same words are each reported; empty tables give nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

BLOCK = 400_000
GAP = 256
#: The queries are broadcast within closures: beyond this many words the caller has to send them in portions.
MAX_QUERY_WORDS = 2_000_000

_WORD = re.compile("[a-z0-9]+")
_DROPPED = {c: None for c in map(ord, "'’‘ʼ＇")}


class _Invisible(dict):
    """For translate: drops format characters; remembers what it has seen."""

    def __missing__(self, code: int):
        self[code] = value = None if unicodedata.category(chr(code)) == "Cf" else code
        return value


_invisible = _Invisible()


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_invisible)).lower().translate(_DROPPED)
    else:
        text = text.lower()
        if "'" in text:
            text = text.replace("'", "")
    return _WORD.findall(text)


INDEX = "doc_ids array<long>, starts array<int>, terms string, counts binary, postings binary"
_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("terms", pa.string()), ("counts", pa.binary()), ("postings", pa.binary())])


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers as four byte planes: small numbers leave planes of zeros, which the table's codec removes."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _block(doc_ids: list[int], lengths: list[int], codes: np.ndarray, vocabulary: dict[str, int]) -> pa.RecordBatch:
    n = np.array(lengths, np.int64)
    starts = np.concatenate(([0], np.cumsum(n + GAP)[:-1]))
    position = np.arange(len(codes)) + np.repeat(np.arange(len(n)) * GAP, n)
    order = np.argsort(codes, kind="stable")
    at, counts = position[order], np.bincount(codes, minlength=len(vocabulary))
    delta = np.diff(at, prepend=0)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    delta[first] = at[first]
    row = [[doc_ids], [starts.tolist()], [" ".join(vocabulary)], [_planes(counts)], [_planes(delta)]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _INDEX)], schema=_INDEX)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    lengths: list[int] = []
    codes: list[np.ndarray] = []
    vocabulary: dict[str, int] = {}
    total = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = words(text.as_py())
            if not own:
                continue
            for w in set(own).difference(vocabulary):
                vocabulary[w] = len(vocabulary)
            codes.append(np.fromiter(map(vocabulary.__getitem__, own), np.int32, len(own)))
            ids.append(doc)
            lengths.append(len(own))
            total += len(own) + GAP
            if total >= BLOCK:
                yield _block(ids, lengths, np.concatenate(codes), vocabulary)
                ids, lengths, codes, vocabulary, total = [], [], [], {}, 0
    if ids:
        yield _block(ids, lengths, np.concatenate(codes), vocabulary)


def index(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The inverted index of the documents' texts: a table of the shared folder, a row per block."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return materialise(rows.mapInArrow(_index, INDEX), "index")


@dataclass
class Query:
    """A query's words, and what to find of it."""

    number: int
    words: list[str]


def load_queries(items: DataFrame, item_id: str, text: str) -> list[Query]:
    """The query texts, whose size is bounded and checked before they are gathered."""
    size = items.agg(F.sum(F.length(text))).first()[0] or 0
    if size > 4 * MAX_QUERY_WORDS:
        raise ValueError("too many query words to send to every block; search them in portions")
    rows = items.select(F.col(item_id).cast("long"), F.col(text)).where(F.col(text).isNotNull()).collect()
    return [Query(r[0], words(r[1])) for r in rows]


class _Block:
    """One row of the index, opened."""

    def __init__(self, doc_ids, starts, terms: str, counts: bytes, postings: bytes):
        self.doc_ids, self.starts = np.asarray(doc_ids, np.int64), np.asarray(starts, np.int64)
        self.term = {t: i for i, t in enumerate(terms.split(" "))}
        self.counts = _numbers(counts)
        self.ends = np.cumsum(self.counts)
        self.planes = np.frombuffer(postings, np.uint8).reshape(4, -1)
        self._lists: dict[str, np.ndarray] = {}

    def count(self, term: str) -> int:
        i = self.term.get(term)
        return 0 if i is None else int(self.counts[i])

    def positions(self, term: str) -> np.ndarray:
        """Ascending positions of a term's postings; only the lists asked for are decoded."""
        found = self._lists.get(term)
        if found is None:
            i = self.term[term]
            part = self.planes[:, self.ends[i] - self.counts[i] : self.ends[i]]
            found = self._lists[term] = np.cumsum(np.ascontiguousarray(part.T).view("<u4").ravel().astype(np.int64))
        return found

    def documents(self, positions: np.ndarray) -> np.ndarray:
        """Numbers of the documents in which the positions lie."""
        return np.unique(np.searchsorted(self.starts, positions, side="right") - 1)

    def phrase(self, own: list[str]) -> np.ndarray:
        """Positions at which the words stand in order, one after another."""
        by_rarity = sorted(range(len(own)), key=lambda i: self.count(own[i]))
        at = None
        for i in by_rarity:
            if not self.count(own[i]):
                return np.empty(0, np.int64)
            shifted = self.positions(own[i]) - i
            at = shifted if at is None else at[_among(at, shifted)]
            if not len(at):
                break
        return at


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of the values stand in an ascending list."""
    i = np.searchsorted(ascending, values)
    i[i == len(ascending)] = 0
    return ascending[i] == values


def exact(block: _Block, query: Query, least: int) -> np.ndarray:
    """Numbers of the documents that hold ``least`` consecutive words of the query.

    A run of that length is found by the words in it: alignments (position minus offset) are taken from the rarest word of
    each window; per alignment the query's matching words are then looked up, and runs of ``least`` of them kept.
    """
    own = query.words
    n = len(own)
    if n < least:
        return np.empty(0, np.int64)
    count = [block.count(w) for w in own]
    missing = np.cumsum([0, *(c == 0 for c in count)])
    anchors: list[int] = []
    for i in range(n - least + 1):
        if missing[i + least] == missing[i] and (not anchors or anchors[-1] < i):
            anchors.append(max(range(i, i + least), key=lambda k: (-count[k], k)))
    # every window whose words all occur now holds an anchor
    held = [np.empty(0, np.int64)]
    for a in anchors:
        at = block.positions(own[a]) - a
        run = np.ones(len(at), np.int64)
        for step in (-1, 1):
            alive, k = np.arange(len(at)), a + step
            while len(alive) and 0 <= k < n and abs(k - a) < least and count[k]:
                alive = alive[_among(at[alive] + k, block.positions(own[k]))]
                run[alive] += 1
                k += step
        held.append(at[run >= least] + a)
    return block.documents(np.concatenate(held))


def near(block: _Block, query: Query, share: float, window: int) -> dict[int, int]:
    """Documents (by number) of which some ``window`` consecutive words hold at least ``share`` of the query's distinct words, with the most they hold.

    The window is at least as long as the query, so an exact copy fits; it never reaches over a document's ends. Such a window lacks few words, so it holds one of the query's rarest ones, around which it is looked for.
    """
    own = sorted(set(query.words), key=lambda w: (block.count(w), w))
    window = max(window, len(query.words))
    need = math.ceil(len(own) * share - 1e-9)
    best: dict[int, int] = {}
    for a in range(len(own) - need + 1 if own else 0):
        if not block.count(own[a]):
            continue
        at = block.positions(own[a])
        seen = np.ones(len(at), np.int64)
        others = [w for k, w in enumerate(own) if k != a]
        for k, word in enumerate(others):
            if block.count(word):
                where = block.positions(word)
                seen += np.searchsorted(where, at + window - 1, side="right") > np.searchsorted(where, at - window + 1)
            alive = seen + (len(others) - 1 - k) >= need
            at, seen = at[alive], seen[alive]
            if not len(at):
                break
        for p in at[seen >= need].tolist():
            n = _densest(block, own, p, window)
            if n >= need:
                d = int(np.searchsorted(block.starts, p, side="right")) - 1
                best[d] = max(best.get(d, 0), n)
    return best


def _densest(block: _Block, own: list[str], p: int, window: int) -> int:
    """Most distinct words in any ``window`` consecutive positions of p's document that include p."""
    d = int(np.searchsorted(block.starts, p, side="right"))
    low = max(p - window + 1, int(block.starts[d - 1]))
    high = min(p + window - 1, int(block.starts[d]) - 1) if d < len(block.starts) else p + window - 1
    around = []
    for word in own:
        if block.count(word):
            where = block.positions(word)
            around += [(x, word) for x in where[np.searchsorted(where, low) : np.searchsorted(where, high, side="right")].tolist()]
    around.sort()
    most, first, inside = 0, 0, Counter()
    for x, word in around:
        inside[word] += 1
        while x - around[first][0] >= window:
            gone = around[first][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            first += 1
        most = max(most, len(inside))
    return most


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch.column(0)[i].values.to_numpy(), batch.column(1)[i].values.to_numpy(), *(batch.column(c)[i].as_py() for c in (2, 3, 4)))


def phrases(blocks: DataFrame, queries: list[Query], least: int) -> DataFrame:
    """doc_id, item_id: documents with ``least`` consecutive words of the item."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _opened(batches):
            docs, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for query in shared.value:
                found = block.doc_ids[exact(block, query, least)]
                docs.append(found)
                items.append(np.full(len(found), query.number))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(items))], schema=schema)

    return blocks.mapInArrow(search, "doc_id long, item_id long")


def whole(blocks: DataFrame, queries: list[Query]) -> DataFrame:
    """doc_id, item_id, n_times: documents that hold an item's words as a whole, one after another."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_times", pa.int64())])
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _opened(batches):
            for query in shared.value:
                at = block.phrase(query.words) if query.words else ()
                if len(at):
                    docs, times = np.unique(np.searchsorted(block.starts, at, side="right") - 1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids[docs]), pa.array(np.full(len(docs), query.number)), pa.array(times)], schema=schema)

    return blocks.mapInArrow(search, "doc_id long, item_id long, n_times long")


def proximity(blocks: DataFrame, queries: list[Query], share: float, window: int) -> DataFrame:
    """doc_id, item_id, n_words, n_near: documents of which ``window`` words (more for a longer item) hold ``share`` of the item's distinct words, in any order."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("n_near", pa.int32())])
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _opened(batches):
            for query in shared.value:
                found = near(block, query, share, window)
                if found:
                    n = len(found)
                    docs = block.doc_ids[np.fromiter(found, np.int64, n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs), pa.array(np.full(n, query.number)), pa.array(np.full(n, len(set(query.words)), np.int32)), pa.array(list(found.values()), pa.int32())], schema=schema
                    )

    return blocks.mapInArrow(search, "doc_id long, item_id long, n_words int, n_near int")
