"""Frequency of every distinct term, by heavy-light aggregation.

A bounded sketch finds the heavy terms. They are broadcast, and each partition adds them up in an exact local array of counters, of
which one row per term and partition leaves it; only the remaining terms are shuffled. Heavy or light changes where a
term is counted, never what is counted: the union of both tables is exact whatever the sketch says.

Input: one row per record with the list of its terms, so a record is counted once however often it was delivered and however often it
holds a term. Defined results: null terms are left out; an empty string is a term; repeated terms of one record count as
several occurrences in one record; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import if_small

#: At most this many heavy terms are broadcast, each of at most this many characters: a bound of 32 MB.
HEAVY, HEAVY_CHARS = 4096, 2000


def heavy_terms(records: DataFrame) -> list[tuple[str, str]]:
    """(field, term) pairs that are frequent by the sketch: per field its HEAVY most frequent ones, bounded in the sketch itself."""
    terms = records.select("field", F.explode("terms").alias("term")).where("term is not null").where(F.length("term") <= HEAVY_CHARS)
    top = terms.groupBy("field").agg(F.expr(f"approx_top_k(term, {HEAVY // 4}, {HEAVY * 4})").alias("top"))
    found = top.select("field", F.inline("top")).orderBy(F.desc("count"), "field", "item").limit(HEAVY).collect()
    return [(r["field"], r["item"]) for r in found]


def _counters(heavy: list[tuple[str, str]]):
    """For mapInArrow: heavy terms are added up per partition, the others leave it row by row, per record."""
    index = {pair: i for i, pair in enumerate(heavy)}
    schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_records", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, in_records = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            hits: list[int] = []
            own: list[int] = []
            for field, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one: dict[str, int] = {}
                for term in terms or ():
                    if term is not None:
                        one[term] = one.get(term, 0) + 1
                for term, k in one.items():
                    i = index.get((field, term))
                    if i is None:
                        for c, v in zip(out, (field, term, k, 1)):
                            c.append(v)
                    else:
                        hits.append(i)
                        own.append(k)
            in_records += np.bincount(np.array(hits, np.int64), minlength=len(heavy))
            np.add.at(n, np.array(hits, np.int64), np.array(own, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
        seen = np.flatnonzero(in_records)
        values = [[heavy[i][0] for i in seen], [heavy[i][1] for i in seen], n[seen].tolist(), in_records[seen].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(values, schema)], schema=schema)

    return count


def frequencies(records: DataFrame) -> DataFrame:
    """field, term, n_occurrences, n_records of all terms; records has field and terms (array<string>), one row each."""
    counted = records.select("field", "terms").mapInArrow(_counters(heavy_terms(records)), "field string, term string, n long, n_records long")
    # the union of both tables leaves each partition: of a heavy term one row, of the others one per record that holds them
    return counted.groupBy("field", "term").agg(F.sum("n").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def marked(counts: DataFrame, totals: DataFrame, *, rare: int = 2, common: int = 40) -> DataFrame:
    """counts with mark: 'common' if more than 1/common of all records of the field hold the term, else 'rare' if at most ``rare`` do."""
    rows = counts.join(if_small(totals), "field")
    return rows.withColumn("mark", F.when(F.col("n_records") * common > F.col("n_all"), "common").when(F.col("n_records") <= rare, "rare"))
