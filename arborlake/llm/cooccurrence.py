"""Items that appear together: stripes, merged by key, scored by log-likelihood ratio.

Each task holds one associative array (stripe) per item with the counts of the
neighbours seen beside it, and sends the stripes in segments of the neighbour
space once its memory bound is reached or it ends.  The number of segments
grows with the stripe, so a segment has a bounded size.  A hot item has a
stripe in every task: a bounded number of segments is merged by key (item,
block of tasks, segment) in sorted streams, and the sums of the blocks are
added up by pair, with map-side combining, so no task gets all of an item.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of all stripes a task keeps before it sends them on.
MAX_TASK_ENTRIES = 500_000
#: Entries of a stripe's segment, roughly.
SEGMENT_ENTRIES = 4096
#: Tasks, and sendings of a task, whose segments are merged in one place.
BLOCK = 8

_STRIPES = pa.schema([("item", pa.string()), ("block", pa.int64()), ("segment", pa.int32()), ("neighbours", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_STRIPES_DDL = "item string, block bigint, segment int, neighbours array<string>, counts array<bigint>"
_PAIRS = pa.schema([("item_a", pa.string()), ("item_b", pa.string()), ("n_ab", pa.int64())])
_PAIRS_DDL = "item_a string, item_b string, n_ab bigint"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _send(stripes: dict[str, Counter], block: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    hashed: dict[str, int] = {}
    for item, counts in stripes.items():
        segments = 1 << (len(counts) // SEGMENT_ENTRIES).bit_length()
        if segments == 1:
            rows.append((item, block, 1, list(counts), list(counts.values())))
        else:
            split: dict[int, tuple[list, list]] = {}
            for neighbour, n in counts.items():
                at = hashed.get(neighbour)
                if at is None:
                    at = hashed[neighbour] = zlib.crc32(neighbour.encode())
                names, numbers = split.setdefault(segments + at % segments, ([], []))
                names.append(neighbour)
                numbers.append(n)
            rows += [(item, block, segment, *both) for segment, both in split.items()]
        if len(rows) >= 4096:
            yield _batch(rows, _STRIPES)
            rows = []
    if rows:
        yield _batch(rows, _STRIPES)


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes: dict[str, Counter] = {}
    entries = sent = 0
    task = TaskContext.get()
    blocks = (task.partitionId() if task else 0) // BLOCK << 32
    for batch in batches:
        for items in batch.column(0).to_pylist():
            items.sort()
            for i in range(len(items) - 1):
                own = stripes.get(items[i])
                if own is None:
                    own = stripes[items[i]] = Counter()
                # a very long record is taken in parts, so that the bound holds within it as well
                for start in range(i + 1, len(items), MAX_TASK_ENTRIES):
                    before = len(own)
                    own.update(items[start : start + MAX_TASK_ENTRIES])
                    entries += len(own) - before
                    if entries > MAX_TASK_ENTRIES:
                        yield from _send(stripes, blocks + sent // BLOCK)
                        stripes, entries, sent = {}, 0, sent + 1
                        own = stripes[items[i]] = Counter()
    yield from _send(stripes, blocks + sent // BLOCK)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, merged = None, Counter()

    def emit() -> Iterator[pa.RecordBatch]:
        if merged:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(merged), pa.string()), pa.array(list(merged), pa.string()), pa.array(list(merged.values()), pa.int64())], schema=_PAIRS)

    for batch in batches:
        for item, block, segment, neighbours, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (item, block, segment) != key:
                yield from emit()
                key, merged = (item, block, segment), Counter(dict(zip(neighbours, counts)))
            else:
                for neighbour, n in zip(neighbours, counts):
                    merged[neighbour] += n
    yield from emit()


def cooccurrence(df: DataFrame, record: str, items: str | Column, min_pair: int = 1) -> DataFrame:
    """Pairs of items held by the same record, with counts and significance.

    ``df`` has one row per ``record`` (copies removed by the caller);
    ``items`` is an array of strings.  Result: ``item_a < item_b``, ``n_a``,
    ``n_b``, ``n_ab``, ``n_records``, ``lift`` (observed over expected) and
    ``llr``, Dunning's log-likelihood ratio, signed: negative where the pair is
    rarer than chance.  Only pairs in at least ``min_pair`` records are kept.

    Null or empty lists count as records without items; nulls in a list are
    skipped; an item listed twice in a record counts once; rows with a null
    record are no records; an empty table gives no rows.  Other columns of
    ``df`` are never read.
    """
    records = df.select(F.col(record).alias("record"), F.array_compact(items).alias("items")).filter("record is not null")
    records = records.select("record", F.array_distinct("items").alias("items"))
    counted = records.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    total = df.agg(F.count(record).alias("n")).scalar()
    key = ["item", "block", "segment"]
    pairs = (
        records.filter(F.size("items") > 1)
        .select("items")
        .mapInArrow(_build, _STRIPES_DDL)
        .repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(_merge, _PAIRS_DDL)
        .groupBy("item_a", "item_b")
        .agg(F.sum("n_ab").alias("n_ab"))
        .filter(F.col("n_ab") >= min_pair)
    )
    joined = (
        pairs.join(counted.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(counted.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .withColumn("n_records", total)
    )
    a, b, ab, n = (F.col(c).cast("double") for c in ("n_a", "n_b", "n_ab", "n_records"))
    cells = [(ab, a, b), (a - ab, a, n - b), (b - ab, n - a, b), (n - a - b + ab, n - a, n - b)]
    llr = sum((F.when(k > 0, k * F.log(k * n / (r * c))).otherwise(0.0) for k, r, c in cells), F.lit(0.0))
    lift = n * ab / (a * b)
    return joined.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n_records", lift.alias("lift"), (F.when(lift < 1, -2).otherwise(2) * llr).alias("llr"))
