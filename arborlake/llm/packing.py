"""Filling containers of fixed capacity by hierarchical residual packing.

Each partition packs its items best-fit and in falling size.  Bins that are
nearly full are done; the others travel on as single items, into fewer
partitions each round, and are packed best-fit again, down to as many
partitions as the unfinished bins need.  If that is one, packing is complete.
If not, a round sorts bins by what they lack or hold, so that a bin and what
fits into it meet; after it at most one bin a partition is half full or less.
These and as many of the roomiest others meet in a last task: then no two bins
are left that would fit into one.  No task grows with the collection, and no
round is left out because it brings little.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from arborlake.llm.tokens import DEFAULT_VOCABULARY, token_counts
from arborlake.runtime import broadcast_if_small, cut

#: Share of the capacity from which a bin is done.
NEARLY_FULL = 0.995
#: Items a task packs at a time, and unfinished bins a partition of a later round gets.
ITEMS_AT_ONCE = 200_000
BINS_PER_PARTITION = 20_000
#: Partitions that are merged into one in each round.
FAN_IN = 8



def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of the items of each bin: items in falling size, each into the fullest bin that holds it."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins: list[list[int]] = []
    for i in order:
        need = sizes[i]
        at = bisect_left(rooms, need)
        if at == len(rooms):
            bins.append([i])
            number, room = len(bins) - 1, capacity - need
        else:
            old = rooms[at]
            number = by_room[old].pop()
            if not by_room[old]:
                del by_room[old]
                rooms.pop(at)
            bins[number].append(i)
            room = old - need
        if room > 0:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(number)
    return bins


Bin = tuple[int, list[dict], bool]  # weight, members, whether it is done


def _emit(packed: Iterable[Bin], member: pa.DataType) -> Iterator[pa.RecordBatch]:
    packed = list(packed)
    for start in range(0, len(packed), 2_000):
        size, members, done = zip(*packed[start : start + 2_000])
        yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(members, pa.list_(member)), pa.array(done, pa.bool_())], names=["size", "members", "done"])


def _first_round(capacity: int, member: pa.DataType):
    full = NEARLY_FULL * capacity

    def pack(items: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[dict], bool]]:
        weights = [max(1, size) for _, _, size in items]
        for held in best_fit(weights, capacity):
            weight = sum(weights[i] for i in held)
            yield weight, [{"id": items[i][0], "part": items[i][1], "size": items[i][2]} for i in held], weight >= full

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, int, int]] = []
        for batch in batches:
            for key, size in zip(*(c.to_pylist() for c in batch.columns)):
                whole = 0
                if size > capacity:
                    whole = -(-size // capacity) - 1
                    yield from _emit(((capacity, [{"id": key, "part": part, "size": capacity}], True) for part in range(whole)), member)
                items.append((key, whole, size - whole * capacity))
            if len(items) >= ITEMS_AT_ONCE:
                yield from _emit(pack(items), member)
                items = []
        if items:
            yield from _emit(pack(items), member)

    return run


def _later_round(capacity: int, member: pa.DataType):
    full = NEARLY_FULL * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: list[int] = []
        members: list[list[dict]] = []

        def pack() -> Iterator[tuple[int, list[dict], bool]]:
            for held in best_fit(sizes, capacity):
                weight = sum(sizes[i] for i in held)
                yield weight, [m for i in held for m in members[i]], weight >= full

        for batch in batches:
            sizes += batch.column(0).to_pylist()
            members += batch.column(1).to_pylist()
            if len(sizes) >= ITEMS_AT_ONCE:
                yield from _emit(pack(), member)
                sizes, members = [], []
        if sizes:
            yield from _emit(pack(), member)

    return run


def pack_items(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """A pack for every item: ``id``, ``part``, ``size``, ``pack_id`` and ``pack_size``, the sum of the sizes in the pack.

    An item is never divided unless it is larger than ``capacity``; then it
    fills packs of its own with parts of exactly ``capacity`` and the rest is
    an item like others.  The sizes of a pack's parts never exceed the
    capacity; items of size 0 or null take the room of 1 there, which bounds
    the members of a pack.  Keys may be of any type; equal keys are separate
    items; rows with a null key are left out; an empty table gives no rows.
    Pack numbers are unique, not consecutive.
    """
    if capacity < 1:
        raise ValueError("the capacity is at least 1")
    rows = items.select(F.col(key).alias("id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size")).filter("id is not null")
    kind = rows.schema["id"].dataType
    member = pa.struct([("id", to_arrow_type(kind)), ("part", pa.int64()), ("size", pa.int64())])
    ddl = T.StructType(
        [
            T.StructField("size", T.LongType()),
            T.StructField("members", T.ArrayType(T.StructType([T.StructField("id", kind), T.StructField("part", T.LongType()), T.StructField("size", T.LongType())]))),
            T.StructField("done", T.BooleanType()),
        ]
    )
    finished: list[DataFrame] = []

    def merge(bins: DataFrame) -> tuple[DataFrame, int]:
        packed = cut(bins.mapInArrow(_later_round(capacity, member), ddl))
        finished.append(packed.filter("done"))
        open_bins = packed.filter("not done")
        return open_bins, open_bins.count()

    packed = cut(rows.mapInArrow(_first_round(capacity, member), ddl))
    finished.append(packed.filter("done"))
    rest = packed.filter("not done")
    partitions, held, most = packed.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(~F.col("done")).alias("n"), F.sum(F.size("members")).alias("m")).agg(F.count("*"), F.sum("n"), F.max("m")).first()
    held = held or 0
    if partitions == 1 and most > ITEMS_AT_ONCE:
        partitions = 2  # packed in several runs
    while held > 1 and partitions > 1:
        needed = -(-held // BINS_PER_PARTITION)
        if partitions <= needed:
            break
        partitions = max(-(-partitions // FAN_IN), needed)
        rest, held = merge(rest.repartition(partitions))
    if held > 1 and partitions > 1:
        # a bin of more than half meets what fills its room, a smaller one what it fits into; the second key parts equal sizes
        near = F.least(F.col("size"), capacity - F.col("size"))
        rest, held = merge(rest.repartitionByRange(partitions, near, F.xxhash64("members")))
        # the bins lie in checkpoint files, so their numbers stay the same
        rest = rest.withColumn("_bin", F.monotonically_increasing_id())
        small = F.col("size") <= capacity // 2
        count = rest.filter(small).count()
        # of k smaller bins at most one stays alone, and only if none of the k roomiest others, and so no other, can take it
        roomy = rest.filter(~small).orderBy("size", "_bin").limit(count).select("_bin")
        last = rest.filter(small).select("_bin").unionByName(roomy)
        last = broadcast_if_small(cut(last), 2 * count)
        together, _ = merge(rest.join(last, "_bin", "left_semi").drop("_bin").repartition(1))
        rest = rest.join(last, "_bin", "left_anti").drop("_bin").unionByName(together)
    bins = rest
    for part in finished:
        bins = bins.unionByName(part)
    total = F.aggregate("members", F.lit(0).cast("bigint"), lambda t, m: t + m["size"])
    numbered = bins.select(F.monotonically_increasing_id().alias("pack_id"), total.alias("pack_size"), "members")
    return numbered.select("pack_id", "pack_size", F.explode("members").alias("m")).select("m.id", "m.part", "m.size", "pack_id", "pack_size")


def pack_texts(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``pack_items`` over the token counts of texts; null and empty texts have 0 tokens."""
    return pack_items(token_counts(df, {"id": F.col(key)}, text, vocabulary), "id", "n_tokens", capacity)


def divided(packs: DataFrame) -> DataFrame:
    """The ids of items that had to be divided: those with a part beyond the first."""
    return packs.filter("part > 0").select("id").distinct()


def fill(packs: DataFrame, capacity: int) -> DataFrame:
    """One row: items, packs and the share of the capacity that is used."""
    by_pack = packs.groupBy("pack_id").agg(F.sum("size").alias("used"), F.count("*").alias("parts"))
    used: Column = F.sum("used")
    return by_pack.agg(F.count("*").alias("packs"), used.alias("tokens"), F.sum("parts").alias("parts"), (used / (F.count("*") * capacity)).alias("filled"))
