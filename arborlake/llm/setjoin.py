"""All similar pairs between set-valued records by pigeonhole partitioning.

Two sets whose Jaccard similarity reaches the threshold differ in at most H
values, H following from their lengths.  The token universe is split by a hash
into m segments, m = H // 2 + 1 for the length class of the larger set.  The
smaller set covers H + 1 differences: each segment it enters as it is covers
one, each it enters with one-deletion signatures covers two.  If every entered
segment differed in more than it covers, the sets would differ in more than H;
so at least one segment is equal or, where it was entered so, becomes equal
once one value is dropped from one side.  Joining on segment and one-deletion
signatures thus loses no pair; candidates are verified exactly on the values.

A segment that holds no value would match all others without one.  Each length
class therefore has independent splits: the smaller set is entered under all
of them, and the larger set picks the one where its segments are most even.
Equal sets are collapsed to one class before anything is joined; a class is
named by the 128-bit digest of its set, so no numbering and no join with the
records is needed to find a record's class.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Independent splits of the universe for each length class.  About one set in 4,000 has a segment without a value in both; it meets the one set in
#: a hundred that has the same, and the bitmap tells them apart.  A third split would make that one in 250,000 and costs a third of all entries.
SPLITS = 2
#: Length classes grow by this ratio; a class of short sets is a single length.
CLASS_RATIO = 1.08

_SIGNATURES = "signature bigint, sid binary, size int, bits bigint"
_SCHEMA = pa.schema([("signature", pa.int64()), ("sid", pa.binary()), ("size", pa.int32()), ("bits", pa.int64())])
# What a signature stands for: a segment as it is, the same where one value may differ, and one with a value dropped.
_SAME, _NEAR, _DROPPED = range(3)


def max_difference(larger: int, smaller: int, threshold: Fraction) -> int:
    """Most values in which two sets of these lengths may differ at the threshold."""
    return int((1 - threshold) * (larger + smaller) / (1 + threshold))


@lru_cache(maxsize=100_000)
def length_class(length: int) -> int:
    """The greatest length of the class that ``length`` belongs to."""
    top = 1
    while top < length:
        top = max(top + 1, int(top * CLASS_RATIO))
    return top


@lru_cache(maxsize=100_000)
def classes_of_partners(length: int, threshold: Fraction) -> tuple[tuple[int, int, int], ...]:
    """Classes of the sets that may be the larger partner of one of ``length`` values, their number of segments and the most values of difference."""
    most = int(length / threshold)
    tops = dict.fromkeys(length_class(n) for n in range(length, most + 1))
    return tuple((top, segments(top, threshold), max_difference(min(top, most), length, threshold)) for top in tops)


@lru_cache(maxsize=100_000)
def segments(top: int, threshold: Fraction) -> int:
    return max_difference(top, top, threshold) // 2 + 1


_MASK = (1 << 64) - 1


@lru_cache(maxsize=1_000_000)
def _salt(*key: int) -> int:
    return xxhash.xxh3_64_intdigest(struct.pack(f"<{len(key)}Q", *key))


def _split(tokens: list[int], top: int, count: int, split: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(count)]
    salt = (top * SPLITS + split) * 0x9E3779B97F4A7C15
    for t in tokens:
        out[((t ^ salt) * 0xD6E8FEB86659FD93 >> 29 & 0xFFFFFFFF) % count].append(t)
    return out


def probes_of(tokens: list[int], threshold: Fraction) -> list[int]:
    """Signatures of a set of 64-bit token hashes as the larger partner: those of its most even split, each segment in every way it may be met.

    A segment's signature is the sum of its hashes and a salt of its place, so that one value is dropped by a subtraction.
    """
    top = length_class(len(tokens))
    count = segments(top, threshold)
    split, parts = max(((s, _split(tokens, top, count, s)) for s in range(SPLITS)), key=lambda x: min(map(len, x[1])))
    out = []
    for i, part in enumerate(parts):
        total = sum(part)
        near = total + _salt(top, split, i, _NEAR)
        out += (total + _salt(top, split, i, _SAME) & _MASK, near & _MASK)
        # met by a segment that has one value less
        out += [near - t & _MASK for t in part]
        # met by a segment of which one value was dropped
        out.append(total + _salt(top, split, i, _DROPPED) & _MASK)
    return out


def entries_of(tokens: list[int], threshold: Fraction) -> list[int]:
    """Signatures of a set as the smaller partner: for all splits of all classes that a larger partner may be in, as many as cover the difference."""
    out = []
    for top, count, differ in classes_of_partners(len(tokens), threshold):
        # every segment covers one value of difference; the largest, being the most telling, cover a second one
        twice = differ + 1 - count
        for split in range(SPLITS):
            parts = _split(tokens, top, count, split)
            order = sorted(range(count), key=lambda i: -len(parts[i])) if count > 1 else (0,)
            if twice < 0:
                order = order[: differ + 1]
            for rank, i in enumerate(order):
                total = sum(parts[i])
                if rank < twice:
                    out.append(total + _salt(top, split, i, _NEAR) & _MASK)
                    dropped = total + _salt(top, split, i, _DROPPED)
                    out += [dropped - t & _MASK for t in parts[i]]
                else:
                    out.append(total + _salt(top, split, i, _SAME) & _MASK)
    return out


def _signatures(make, threshold: Fraction):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def hashed(token: str) -> int:
            h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
            if len(token) <= 64:
                if len(known) >= 200_000:
                    known.clear()
                known[token] = h
            return h

        for batch in batches:
            start, made, counts, sizes, bitmaps = 0, [], [], [], []
            for row, tokens in enumerate(batch.column(1).to_pylist()):
                hashes = [known[t] if t in known else hashed(t) for t in tokens]
                bits = 0
                for h in hashes:
                    bits |= 1 << (h >> 58)
                signatures = dict.fromkeys(make(hashes, threshold))
                made += signatures
                counts.append(len(signatures))
                sizes.append(len(hashes))
                bitmaps.append(bits)
                if len(made) > 50_000:
                    yield _batch(batch.column(0).slice(start, len(counts)), made, counts, sizes, bitmaps)
                    start, made, counts, sizes, bitmaps = row + 1, [], [], [], []
            if counts:
                yield _batch(batch.column(0).slice(start, len(counts)), made, counts, sizes, bitmaps)

    return run


def _batch(sids: pa.Array, made: list[int], counts: list[int], sizes: list[int], bitmaps: list[int]) -> pa.RecordBatch:
    """A row per signature; what belongs to a set is repeated for each of its signatures."""
    at = np.repeat(np.arange(len(counts)), counts)
    signed = lambda values: np.array(values, dtype=np.uint64).view(np.int64)
    columns = [pa.array(signed(made)), sids.take(pa.array(at)), pa.array(np.array(sizes, dtype=np.int32)[at]), pa.array(signed(bitmaps)[at])]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def set_classes(df: DataFrame, record: str, values: Column, min_size: int = 1, group: Column | None = None, copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records collapsed to classes of equal sets.

    Returns ``classes`` (``sid``, ``tokens``) and ``members`` (``sid``,
    ``record``, ``group``, ``size``).  Nulls within a list are dropped, repeats count once, null lists
    and sets of fewer than ``min_size`` values are left out, as are rows with a
    null record.  With ``copies`` a record that occurs several times with the
    same values is one; only the narrow ``members`` are shuffled for that.
    """
    own = F.lit(None).cast("string") if group is None else group
    rows = df.select(F.col(record).alias("record"), F.array_sort(F.array_distinct(F.array_compact(values))).alias("tokens"), own.alias("group"))
    rows = rows.filter(F.col("record").isNotNull() & (F.size("tokens") >= max(1, min_size)))
    # never null; joins ask for that, and asking here as well lets all uses of the classes share one shuffle
    rows = rows.withColumn("sid", F.unhex(F.md5(F.to_json("tokens")))).filter("sid is not null")
    classes = rows.groupBy("sid").agg(F.first("tokens").alias("tokens"))
    members = rows.select("sid", "record", "group", F.size("tokens").alias("size"))
    return classes, members.distinct() if copies else members


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """All pairs of different classes with Jaccard similarity of at least ``threshold``: ``sid_a``, ``sid_b``, ``shared``, ``united``.

    ``sid_a`` is the smaller set; of equally long ones, the one of lower sid.
    """
    exact = Fraction(str(threshold))
    if not 0 < exact <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    sets = classes.select("sid", "tokens")
    made = {
        side: sets.mapInArrow(_signatures(make, exact), _SIGNATURES).select("signature", *(F.col(c).alias(f"{c}_{side}") for c in ("sid", "size", "bits")))
        for side, make in (("a", entries_of), ("b", probes_of))
    }
    order = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("sid_a") < F.col("sid_b")))
    p, q = exact.numerator, exact.denominator
    # bits in which the two bitmaps differ never outnumber the values in which the sets differ
    near = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) * (q + p) <= (q - p) * (F.col("size_a") + F.col("size_b"))
    candidates = made["a"].join(made["b"], "signature").filter(order & near).select("sid_a", "sid_b").distinct()
    left = classes.select(F.col("sid").alias("sid_a"), F.col("tokens").alias("tokens_a"))
    right = classes.select(F.col("sid").alias("sid_b"), F.col("tokens").alias("tokens_b"))
    both = candidates.join(left, "sid_a").join(right, "sid_b")
    both = both.withColumn("shared", F.size(F.array_intersect("tokens_a", "tokens_b")))
    both = both.withColumn("united", F.size("tokens_a") + F.size("tokens_b") - F.col("shared"))
    return both.filter(F.col("shared") * q >= F.col("united") * p).select("sid_a", "sid_b", "shared", "united")


def set_similarity_classes(df: DataFrame, record: str, values: Column, threshold: float, min_size: int = 1, copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members (record to class) and the similar pairs between classes; the form in which copies are not expanded."""
    classes, members = set_classes(df, record, values, min_size, copies=copies)
    return members.drop("group", "size"), similar_classes(classes, threshold)


def set_similarity_pairs(df: DataFrame, record: str, values: Column, group: Column, threshold: float, min_size: int = 1, copies: bool = False) -> DataFrame:
    """Every pair of records of different ``group`` whose sets overlap by at least ``threshold`` (shared over united).

    Result: ``rec_a`` < ``rec_b`` as plain strings, ``shared`` and ``united``.
    Equal sets are joined as classes and only expanded at the end.  A null group
    differs from none, so such records have no pairs.  A record that occurs twice counts as
    two, unless ``copies`` says that its rows are the same; an empty table gives
    no rows.
    """
    classes, members = set_classes(df, record, values, min_size, group, copies)
    members = members.filter("group is not null")
    # classes whose records are all of one group have no pairs of their own; the count makes the plan read the shuffled members here as well
    wide = members.groupBy("sid").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.max("size").alias("size"), F.count("*").alias("n")).filter("lo < hi and n > 1")
    own = wide.select(F.col("sid").alias("sid_a"), F.col("sid").alias("sid_b"), F.col("size").alias("shared"), F.col("size").alias("united"))
    pairs = similar_classes(classes, threshold).unionByName(own)
    a = members.select(F.col("sid").alias("sid_a"), F.col("record").alias("r_a"), F.col("group").alias("g_a"))
    b = members.select(F.col("sid").alias("sid_b"), F.col("record").alias("r_b"), F.col("group").alias("g_b"))
    joined = pairs.join(a, "sid_a").join(b, "sid_b").filter("g_a <> g_b and (sid_a <> sid_b or r_a < r_b)")
    return joined.select(F.least("r_a", "r_b").alias("rec_a"), F.greatest("r_a", "r_b").alias("rec_b"), "shared", "united")
