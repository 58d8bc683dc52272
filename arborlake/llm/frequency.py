"""Frequency of every distinct term: an external sort by range, then run-length scanning.

Pairs of term and record are range-partitioned and sorted by (field, term,
record); Spark's sort spills to disk.  A linear scan of each range turns runs
into counts.  Equal pairs never straddle two ranges, so a term cut in two by a
range border, as very frequent terms are, has counts that simply add up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DDL = "field string, term string, occurrences bigint, records bigint"


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; the first position is False."""
    out = np.zeros(len(column), dtype=bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


def scan_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each run of (field, term) in sorted batches of (field, term, record)."""
    key, last, occurrences, records = None, None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        field, term, record = batch.columns
        new_term = _changes(field) | _changes(term)
        new_record = new_term | _changes(record)
        first = (field[0].as_py(), term[0].as_py())
        new_term[0] = True
        starts = np.flatnonzero(new_term)
        new_record[0] = first != key or record[0].as_py() != last
        lengths = np.diff(np.append(starts, batch.num_rows))
        distinct = np.add.reduceat(new_record.astype(np.int64), starts)
        done: list[tuple] = []
        for start, length, n in zip(starts.tolist(), lengths.tolist(), distinct.tolist()):
            now = (field[start].as_py(), term[start].as_py())
            if now != key:
                if key is not None:
                    done.append((*key, occurrences, records))
                key, occurrences, records = now, 0, 0
                # the run's first record is new to a new term
                n = max(n, 1)
            occurrences += length
            records += n
        last = record[batch.num_rows - 1].as_py()
        if done:
            yield _batch(done)
    if key is not None:
        yield _batch([(*key, occurrences, records)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["field", "term", "occurrences", "records"])


def term_frequencies(df: DataFrame, record: str, fields: Mapping[str, Column], rare_at_most: int = 2, common_share: float = 0.125) -> DataFrame:
    """Occurrences of every distinct term and the number of records that hold it, with a mark.

    ``df`` has one row per ``record`` (copies removed by the caller); ``fields``
    maps a name to an array of strings.  Result: ``field``, ``term``,
    ``occurrences``, ``records``, ``field_records`` (records whose list for the
    field is not null) and ``mark``: 'rare' if at most ``rare_at_most`` records
    hold the term, else 'common' if at least the share ``common_share`` of
    ``field_records`` do, else null.

    Null lists don't count as records of the field, empty ones do; nulls in a
    list are skipped; an empty string is a term; repeats count as occurrences;
    rows with a null record are skipped; an empty table gives no rows.
    """
    rows = df.select(F.col(record).alias("record"), *(c.alias(f"f{i}") for i, c in enumerate(fields.values()))).filter("record is not null")
    lists = F.array(*(F.struct(F.lit(name).alias("field"), F.col(f"f{i}").alias("terms")) for i, name in enumerate(fields)))
    held = rows.select("record", F.explode(lists).alias("l")).select("l.field", "l.terms", "record")
    pairs = held.select("field", F.explode("terms").alias("term"), "record").filter("term is not null")
    key = ["field", "term", "record"]
    runs = pairs.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(scan_runs, _DDL)
    counts = runs.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    # one row per field: its size is that of the ``fields`` argument
    sizes = held.filter("terms is not null").groupBy("field").agg(F.count("*").alias("field_records"))
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") >= common_share * F.col("field_records"), "common")
    return counts.join(F.broadcast(sizes), "field").select("field", "term", "occurrences", "records", "field_records", mark.alias("mark"))
