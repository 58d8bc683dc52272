import math
import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from arborlake.llm import cooccurrence as co
from arborlake.llm.cooccurrence import cooccurrence
from arborlake.llm.frequency import term_frequencies
from arborlake.llm.percentiles import merge_summaries, percentile_summary, radix_percentiles, summary_percentiles
from arborlake.llm.setjoin import entries_of, probes_of, set_similarity_classes, set_similarity_pairs

ITEMS = "record int, items array<string>, n int"


def baskets(count, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.choice("abcdefghij") + str(rng.randint(0, 2)) for _ in range(rng.randint(0, 7))], i) for i in range(count)]


def brute_pairs(rows):
    sets = [set(x for x in items or [] if x is not None) for r, items, _ in rows if r is not None]
    one = Counter(x for s in sets for x in s)
    both = Counter(p for s in sets for p in combinations(sorted(s), 2))
    return {(a, b): (one[a], one[b], n, len(sets)) for (a, b), n in both.items()}


@pytest.mark.parametrize("bound", [co.MAX_TASK_ENTRIES, 3])
def test_pairs_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(co, "MAX_TASK_ENTRIES", bound)
    rows = baskets(300) + [(1000, None, 1), (1001, [], 1), (1002, ["a0", None, "a0", "b1"], 1), (None, ["a0", "b1"], 1), (1003, ["", "é" * 5000], 1)]
    got = cooccurrence(spark.createDataFrame(rows, ITEMS).repartition(3), "record", "items").collect()
    assert {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n_records) for r in got} == brute_pairs(rows)


def test_a_long_record_stays_within_the_bound(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(co, "MAX_TASK_ENTRIES", 500)
    monkeypatch.setattr(co, "SEGMENT_ENTRIES", 16)
    held = []
    send = co._send
    monkeypatch.setattr(co, "_send", lambda stripes, block: (held.append(sum(map(len, stripes.values()))), *send(stripes, block))[1:])
    names = [f"i{k:03}" for k in range(600)]
    batches = list(co._build([pa.RecordBatch.from_arrays([pa.array([names, names[:3]])], names=["items"])]))
    assert max(held) <= 1000 and len(held) > 250
    rows = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: r[:3])
    assert max(len(r[3]) for r in rows) < 200
    pairs = Counter()
    for b in co._merge([co._batch(rows, co._STRIPES)]):
        pairs.update({(r["item_a"], r["item_b"]): r["n_ab"] for r in b.to_pylist()})
    want = Counter(combinations(names, 2)) + Counter(combinations(names[:3], 2))
    assert pairs == want


def test_ranks_are_whole_numbers(spark):
    from arborlake.llm.percentiles import rank_of

    cases = [(0.55, 3_281_387_000), (0.55, 5_000_000_000), (0.9, 10), (0.1, 3), (0.999999, 9_000_000_000_000), (0.0, 5), (1.0, 7), (0.5, 1), (1e-6, 4_000_000)]
    df = spark.createDataFrame([(n,) for _, n in cases], "n bigint")
    for q, n in cases:
        got = df.filter(F.col("n") == n).select(rank_of(q, F.col("n")).alias("r")).first().r
        assert got == max(1, math.ceil(Fraction(str(q)) * n)), (q, n)


def test_more_targets_than_are_broadcast(spark, monkeypatch):
    from arborlake.llm import percentiles

    monkeypatch.setattr(percentiles, "MAX_BROADCAST_ROWS", 10)
    rng = random.Random(8)
    rows = [(f"g{rng.randint(0, 30)}", rng.gauss(0, 10**6)) for _ in range(3000)]
    held = {}
    for g, v in rows:
        held.setdefault(g, []).append(v)
    got = {(r["g"], r["q"]): r["value"] for r in radix_percentiles(spark.createDataFrame(rows, "g string, v double"), {"g": F.col("g")}, "v", [0.5, 0.99]).collect()}
    assert got == {(g, q): brute_percentile(v, q) for g, v in held.items() for q in (0.5, 0.99)}


def test_significance(spark):
    rows = [(i, ["x", "y"] if i < 10 else ["x"] if i < 20 else ["z"], 0) for i in range(100)]
    r = next(r for r in cooccurrence(spark.createDataFrame(rows, ITEMS), "record", "items").collect() if (r.item_a, r.item_b) == ("x", "y"))
    k = [[10, 10], [0, 80]]
    n, g = 100, 0.0
    for i in range(2):
        for j in range(2):
            if k[i][j]:
                g += 2 * k[i][j] * math.log(k[i][j] * n / (sum(k[i]) * (k[0][j] + k[1][j])))
    assert r.lift == pytest.approx(5.0) and r.llr == pytest.approx(g)


def test_a_hot_item_and_an_empty_table(spark):
    rows = [(i, ["hot", f"v{i % 50}"], 0) for i in range(2000)]
    got = cooccurrence(spark.createDataFrame(rows, ITEMS).repartition(8), "record", "items", 5).collect()
    assert len(got) == 50 and all(r.n_ab == 40 and r.n_a == 2000 for r in got)
    assert cooccurrence(spark.createDataFrame([], ITEMS), "record", "items").count() == 0


def brute_percentile(values, q):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(q * len(ordered) - 1e-9)) - 1]


@pytest.mark.parametrize("kind", ["double", "bigint", "int", "float"])
def test_exact_percentiles(spark, kind):
    rng = random.Random(5)
    whole = kind in ("bigint", "int")
    big = 2**40 if kind == "bigint" else 2**20
    rows = [(rng.choice(["a", "b", None]), rng.randint(-big, big) if whole else float(round(rng.gauss(0, 1000), 3))) for _ in range(700)] + [("one", 7 if whole else -0.0), ("a", None), ("tie", 5 if whole else 5.5), ("tie", 5 if whole else 5.5)]
    if not whole:
        rows += [("a", float("nan")), ("inf", math.inf), ("inf", -math.inf), ("inf", 1e-310)]
    df = spark.createDataFrame(rows, "g string, v " + ("bigint" if whole else "double")).withColumn("v", F.col("v").cast(kind)).repartition(3)
    held = {}
    for r in df.collect():
        if r.v is not None and not (isinstance(r.v, float) and math.isnan(r.v)):
            held.setdefault(r.g, []).append(r.v)
    got = {(r["g"], r["q"]): (r["n"], r["value"]) for r in radix_percentiles(df, {"g": F.col("g")}, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert got == {(g, q): (len(v), brute_percentile(v, q)) for g, v in held.items() for q in (0.0, 0.25, 0.5, 0.9, 1.0)}


def test_percentiles_of_nothing(spark):
    assert radix_percentiles(spark.createDataFrame([], "g string, v double"), {"g": F.col("g")}, "v", [0.5]).count() == 0
    assert radix_percentiles(spark.createDataFrame([("a", None)], "g string, v double"), {"g": F.col("g")}, "v", [0.5]).count() == 0


def test_summaries_add_up_within_their_error(spark):
    rng = random.Random(6)
    rows = [(day, rng.lognormvariate(3, 2) * rng.choice([1, 1, -1])) for day in range(5) for _ in range(200)]
    df = spark.createDataFrame(rows, "day int, v double")
    days = percentile_summary(df, {"day": F.col("day")}, "v", 1 / 64)
    for r in summary_percentiles(merge_summaries(days.withColumn("all", F.lit(1)), ["all"]), ["all"], [0.1, 0.5, 0.99]).collect():
        exact = brute_percentile([v for _, v in rows], r.q)
        assert r.n == 1000 and r.low <= exact <= r.high
        assert r.high - r.low <= abs(exact) / 64 + 1e-9


def brute_terms(rows):
    count, records, lists = Counter(), {}, 0
    for r, items, _ in rows:
        if r is None or items is None:
            continue
        lists += 1
        for x in items:
            if x is not None:
                count[x] += 1
                records.setdefault(x, set()).add(r)
    mark = lambda n: "rare" if n <= 2 else "common" if 8 * n >= lists else None
    return {x: (n, len(records[x]), lists, mark(len(records[x]))) for x, n in count.items()}


@pytest.mark.parametrize("partitions", [1, 6])
def test_frequencies_equal_brute_force(spark, partitions):
    rows = baskets(200) + [(i, ["hot"] * (i % 3 + 1), 1) for i in range(1000, 3000)] + [(9000, None, 1), (9001, [], 1), (9002, ["", "x" * 10_000, None], 1), (None, ["a0"], 1)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = term_frequencies(spark.createDataFrame(rows, ITEMS), "record", {"f": F.col("items")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r.term: (r.occurrences, r.records, r.field_records, r.mark) for r in got} == brute_terms(rows)
    assert term_frequencies(spark.createDataFrame([], ITEMS), "record", {"f": F.col("items")}).count() == 0


def similar(a, b, t):
    return len(a & b) >= t * len(a | b)


@pytest.mark.parametrize("t", ["0.5", "0.75", "0.8", "0.9", "1"])
def test_signatures_lose_no_pair(t):
    rng = random.Random(11)
    exact = Fraction(t)
    tried = 0
    for _ in range(4000):
        a = {rng.getrandbits(64) for _ in range(rng.randint(1, 40))}
        b = set(a)
        for _ in range(rng.randint(0, max(1, len(a) // 3))):
            b.discard(rng.choice(sorted(b))) if rng.random() < 0.5 and b else b.add(rng.getrandbits(64))
        if not b or not similar(a, b, exact):
            continue
        tried += 1
        small, large = sorted((a, b), key=len)
        assert set(entries_of(sorted(small), exact)) & set(probes_of(sorted(large), exact)), (len(a), len(b))
    assert tried > 300


def records(seed=2, count=120):
    rng = random.Random(seed)
    bases = [[f"t{rng.randint(0, 40)}" for _ in range(rng.randint(1, 12))] for _ in range(15)]
    out = []
    for i in range(count):
        own = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            own.append(f"t{rng.randint(0, 40)}") if rng.random() < 0.5 else own.pop() if own else None
        out.append((f"r{i}", own, f"g{rng.randint(0, 5)}"))
    return out + [("n", None, "g1"), ("e", [], "g1"), (None, ["t1"], "g1"), ("x", ["t1", None, "t1"], None), ("long", ["L" * 20_000, "t1"], "g9"), ("long2", ["t1", "L" * 20_000], "g8")]


@pytest.mark.parametrize("t,least", [(0.75, 1), (0.75, 4), (0.5, 1), (1.0, 1)])
def test_set_join_equals_brute_force(spark, t, least):
    rows = records()
    df = spark.createDataFrame(rows, "rec string, items array<string>, g string").repartition(3)
    sets = [(r, set(x for x in items if x is not None), g) for r, items, g in rows if r is not None and items]
    sets = [x for x in sets if len(x[1]) >= least]
    want = {tuple(sorted((a[0], b[0]))) for a, b in combinations(sets, 2) if a[2] and b[2] and a[2] != b[2] and similar(a[1], b[1], t)}
    got = [(r.rec_a, r.rec_b) for r in set_similarity_pairs(df, "rec", F.col("items"), F.col("g"), t, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    members, pairs = set_similarity_classes(df, "rec", F.col("items"), t, least)
    known = {}
    for r in members.collect():
        known.setdefault(r.sid, set()).add(r.record)
    assert sorted(len(v) for v in known.values()) == sorted(Counter(frozenset(s) for _, s, _ in sets).values())
    classes = list({frozenset(s) for _, s, _ in sets})
    assert pairs.count() == sum(similar(a, b, t) for a, b in combinations(classes, 2))


def test_copies_of_records_count_once(spark):
    rows = records()
    df = spark.createDataFrame(rows + rows[::2], "rec string, items array<string>, g string").repartition(3)
    once = spark.createDataFrame(rows, "rec string, items array<string>, g string")
    pairs = lambda d, **k: sorted((r.rec_a, r.rec_b) for r in set_similarity_pairs(d, "rec", F.col("items"), F.col("g"), 0.75, **k).collect())
    assert pairs(df, copies=True) == pairs(once)
    members, _ = set_similarity_classes(df, "rec", F.col("items"), 0.75, copies=True)
    assert members.count() == sum(r is not None and any(x is not None for x in items or []) for r, items, _ in rows)


def test_set_join_of_nothing(spark):
    df = spark.createDataFrame([], "rec string, items array<string>, g string")
    assert set_similarity_pairs(df, "rec", F.col("items"), F.col("g"), 0.75).count() == 0
