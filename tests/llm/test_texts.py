import os
import random
import re

import pytest
from pyspark.sql import functions as F

from arborlake.llm.handwritten import handwritten_source, source_origin
from arborlake.llm.mixing import Node, mix, spread
from arborlake.llm.packing import best_fit, divided, fill, pack_items, pack_texts
from arborlake.llm.splitting import split_text, split_texts, tree_chunks
from arborlake.llm.tokens import DEFAULT_VOCABULARY, counter, token_counts

needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary here")
ODD_TEXTS = ["", " ", "\n\n\n", "a", "a  b\t\tc \r\n d", "日本語。テキスト" * 50, "x" * 9000, "Ünïcödé 12345 ++ don't  ", " " * 3000, " a　b\x1cc", "=" * 5000 + " a", "😀" * 200]


# 4


BODY = "def f(x):\n    total = x + 1\n    return total  # done\n\n" * 12
FILES = [
    ("src/a.py", ".py", BODY, "handwritten"),
    ("src/a.PY", None, BODY, "handwritten"),
    ("docs/a.md", ".md", "x", None),
    ("Makefile", "", "x", None),
    ("vendor/x/a.go", ".go", "package x\n", "vendored"),
    ("src/vendor_portal/a.go", ".go", "package x\n", "handwritten"),
    ("a/node_modules/x.js", ".js", None, "vendored"),
    ("lib/jquery-3.6.0.js", ".js", "", "vendored"),
    ("src/x.py", ".py", "# left-pad 1.3.0 - (c) the left-pad contributors, released under the BSD licence\n" + BODY, "vendored"),
    ("src/x.pb.go", ".go", None, "generated"),
    ("src/generated/x.ts", ".ts", "", "generated"),
    ("src/generator/x.ts", ".ts", "let x = 1", "handwritten"),
    ("src/x.go", ".go", "// Code generated by stringer; DO NOT EDIT.\r\npackage x\r\n", "generated"),
    ("src/y.go", ".go", "package y\n\n/*\n * This file was automatically generated by x 1.0.\n */\n", "generated"),
    ("src/emit.py", ".py", 'HEAD = "// Code generated by us; DO NOT EDIT."\n' + BODY, "handwritten"),
    ("src/z.py", ".py", "# Do not edit the window while a scan runs.\n# The generated client lives elsewhere; this wrapper is edited by hand.\n" + BODY, "handwritten"),
    ("src/m.min.js", ".js", "", "minified"),
    ("src/m.js", ".js", "var a=b.c,d=e||{};" * 300, "minified"),
    ("src/n.js", ".js", BODY + "// " + "word " * 90, "handwritten"),
    ("src/d.py", ".py", "T = [\n" + "    12345, 678, 0x1f, 99,\n" * 60 + "]\n", "data"),
    ("src/e.c", ".c", "static const char t[] = {\n" + ('    "' + "QUJD" * 19 + '"\n') * 30 + "};\n", "data"),
    ("src/null.py", ".py", None, "handwritten"),
]


def test_origin_of_files(spark):
    rows = [(p, p.rsplit("/", 1)[-1], e, c, i) for i, (p, e, c, _) in enumerate(FILES)]
    df = spark.createDataFrame(rows, "relative_path string, name string, ext string, content string, n int")
    got = {r.n: r.origin for r in source_origin(df).collect()}
    assert {FILES[i][0]: o for i, o in got.items()} == {p: o for p, _, _, o in FILES}
    kept = handwritten_source(df.unionByName(df))
    assert kept.columns == df.columns and kept.count() == 2 * sum(o == "handwritten" for *_, o in FILES)
    mine = handwritten_source(df.withColumn("language", F.lit("mine")).withColumn("chars", F.lit("own")))
    assert {(r.language, r.chars) for r in mine.collect()} == {("mine", "own")}
    assert source_origin(df.limit(0)).count() == 0
    assert source_origin(spark.createDataFrame([(None,) * 5], df.schema)).collect()[0].origin is None


def test_long_lines_of_all_kinds(spark):
    long = ["/" * 300_000, "-" * 300_000 + "x", "# " + "code " * 50_000, '"' + "a" * 500_000 + '"', '"' + '\\"' * 200_000, "\\x41" * 200_000, "`" + "\n" * 300_000, "1 " * 300_000, " " * 300_000 + "x", "'" * 300_001]
    df = spark.createDataFrame([(f"a{i}.js", f"a{i}.js", ".js", t) for i, t in enumerate(long)], "relative_path string, name string, ext string, content string")
    assert source_origin(df).filter("origin is not null").count() == len(long)


def encoded(rng, lines):
    return "".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=76)) + "\n" for _ in range(lines))


def test_data_in_literals_of_all_kinds(spark):
    rng = random.Random(9)
    blob, record = encoded(rng, 60), '{"name": "left pad", "owner": "some one", "licence": "free to use"}'
    escaped = record.replace('"', '\\"')
    long_names = "".join(f"    void shouldReturnNothingWhenTheRepositoryHoldsNoFilesOfKind{c}() {{\n        check(repository, kind);\n    }}\n" for c in "ABCDEFGHIJKLMNOP")
    imports = "".join(f'\t_ "example.com/some/organisation/repository-name/internal/drivers/of_{c}"\n' for c in "abcdefgh")
    files = [
        ("a.py", 'ICON = """\n' + blob + '"""\n', "data"),
        ("b.py", "ICON = '''\n" + ("QUJD" * 19 + "\n") * 60 + "'''\n", "data"),
        ("c.sh", "base64 -d > icon.png <<'EOF'\n" + blob + "EOF\n", "data"),
        ("d.java", 'class D {\n    static final String ICON = """\n' + blob + '        """;\n}\n', "data"),
        ("e.lua", "return [[\n" + blob + "]]\n", "data"),
        ("f.c", "static const char t[] =\n" + f'    "{escaped}"\n' * 40 + ";\n", "data"),
        ("g.py", 'ROWS = """' + f"{record}," * 4 + '"""\n', "data"),
        ("h.py", BODY + 'ICON = """\n' + blob + '"""\n', "data"),
        ("i.py", '"""' + "What this module is for, and how its parts hang together.\n" * 40 + '"""\nfrom own import main\n', "handwritten"),
        ("j.py", BODY * 4 + 'ICON = """\n' + encoded(rng, 10) + '"""\n', "handwritten"),
        ("k.c", ("/*" + "-" * 74 + "*/\n" + "int total(int left, int right);\n" * 2) * 30, "handwritten"),
        ("l.go", "package main\n\nimport (\n" + imports + ")\n\n" + "// What this program is for.\n" * 40, "handwritten"),
        ("m.java", "class M {\n" + long_names + "}\n", "handwritten"),
        ("n.py", BODY + '# it\'s the \\"total\\" that isn\'t shown\n' * 20, "handwritten"),
    ]
    df = spark.createDataFrame([(n, n, None, t) for n, t, _ in files], "relative_path string, name string, ext string, content string")
    assert {r.name: r.origin for r in source_origin(df).collect()} == {n: o for n, _, o in files}


def test_short_texts_and_running_counts(spark):
    getters = "".join(f"def get_{n}(self):\n    return self._box[{i}]\n\n" for i, n in enumerate("abcdefghij"))
    files = [
        ("a.py", "", []),
        ("b.py", "x = 1\n", []),
        ("c.py", "{}", []),
        ("d.py", 'KEY = "0123456789abcdef0123456789abcdef"\n', []),
        ("e.py", "1, 2, 3", []),
        ("f.py", "[" + "17, 4, 288, 31, " * 8 + "]", ["layout"]),
        ("g.py", getters, ["layout"]),
        ("h.py", "class Kind:\n" + "".join(f"    KIND_{c} = {i}\n" for i, c in enumerate("ABCDEFGHIJKL")), []),
        ("i.py", getters + "".join("total(" + ", ".join("a" * k) + ")\n" for k in range(1, 40)), []),
        ("gen_j.py", "# Code generated by x. DO NOT EDIT.\n" + getters, ["notice", "layout"]),
    ]
    df = spark.createDataFrame([(n, n, None, t) for n, t, _ in files], "relative_path string, name string, ext string, content string")
    assert {r.name: r.evidence for r in source_origin(df).collect()} == {n: e for n, _, e in files}


def test_unclosed_literals_of_all_kinds(spark):
    long = ['"' + '\\"' * 200_000, "'" + "\\'" * 200_000, '"""' + '\\"""' * 100_000, "[[" * 200_000, "-a" * 200_000, "\\x4" * 100_000, ("a" * 59 + "_") * 6_000, '"""' + "\\" * 300_001, '""" "' * 100_000]
    df = spark.createDataFrame([(f"a{i}.py", f"a{i}.py", ".py", t) for i, t in enumerate(long)], "relative_path string, name string, ext string, content string")
    assert source_origin(df).filter("origin is not null").count() == len(long)


# 7


def test_best_fit_fills_and_never_overfills():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(2000)]
    bins = best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins) and len(bins) <= 1.02 * sum(sizes) / 100 + 1


@pytest.mark.parametrize("partitions", [1, 20])
def test_packs(spark, partitions):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 30, 60, 99, 100, 101, 250, None])) for i in range(3000)] + [(1, 40), (None, 5), (-7, 1000)]
    df = spark.createDataFrame(rows, "key bigint, size bigint").repartition(partitions)
    packs = pack_items(df, "key", "size", 100)
    got = packs.collect()
    by_pack, by_item = {}, {}
    for r in got:
        by_pack[r.pack_id] = by_pack.get(r.pack_id, 0) + r["size"]
        by_item.setdefault(r.id, []).append((r.part, r["size"]))
    assert max(by_pack.values()) <= 100
    assert sum(len(v) - max(p for p, _ in v) for v in by_item.values() if True) >= 0
    assert sum(s for v in by_item.values() for _, s in v) == sum(s or 0 for k, s in rows if k is not None)
    assert set(by_item) == {k for k, _ in rows if k is not None}
    for key, size in rows:
        if key is not None and key != 1 and (size or 0) <= 100:
            assert by_item[key] == [(0, size or 0)]
    assert [s for _, s in sorted(by_item[-7])] == [100] * 10
    assert {r.id for r in divided(packs).collect()} == {k for k, s in rows if k is not None and (s or 0) > 100}
    full = fill(packs, 100).collect()[0]
    assert full.filled > (0.9 if partitions == 1 else 0.85) and full.packs == len(by_pack)


def test_runs_of_one_partition_are_merged(spark, monkeypatch):
    monkeypatch.setattr("arborlake.llm.packing.ITEMS_AT_ONCE", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        packs = pack_items(spark.range(0, 600, 1, 1).selectExpr("id as key", "1L as size"), "key", "size", 200).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({r.id for r in packs}) == 600 and len({r.pack_id for r in packs}) == 3


def test_bins_that_fit_together_are_found_among_many_that_do_not(spark, monkeypatch):
    monkeypatch.setattr("arborlake.llm.packing.BINS_PER_PARTITION", 50)
    rng = random.Random(3)
    sizes = [rng.randint(58, 64) for _ in range(950)] + [rng.randint(34, 40) for _ in range(50)]
    rng.shuffle(sizes)
    df = spark.createDataFrame([(f"k{i}", s) for i, s in enumerate(sizes)], "key string, size bigint").repartition(40)
    got = pack_items(df, "key", "size", 100).collect()
    assert sorted(r.id for r in got) == sorted(f"k{i}" for i in range(1000))
    bins = sorted({r.pack_id: r.pack_size for r in got}.values())
    assert sum(bins) == sum(sizes) and bins[-1] <= 100 and bins[0] + bins[1] > 100
    assert len(bins) <= 952
    same = pack_items(spark.range(0, 4000, 1, 40).selectExpr("encode(string(id), 'utf-8') as key", "60L as size"), "key", "size", 100)
    assert same.select("pack_id").distinct().count() == 4000


def test_pack_size_is_the_sum_of_the_sizes(spark):
    got = pack_items(spark.createDataFrame([("a", 0), ("b", None), ("c", 7)], "key string, size int"), "key", "size", 10).collect()
    assert {(r.id, r["size"], r.pack_size) for r in got} == {("a", 0, 7), ("b", 0, 7), ("c", 7, 7)}


def test_packs_of_nothing_and_of_big_halves(spark):
    assert pack_items(spark.createDataFrame([], "key bigint, size bigint"), "key", "size", 10).count() == 0
    halves = spark.range(400).selectExpr("id as key", "60L as size").repartition(8)
    assert pack_items(halves, "key", "size", 100).select("pack_id").distinct().count() == 400


# 8


def test_shortage_goes_to_siblings_first():
    leaf = lambda w, c: Node(w, c)
    left, right = Node(children={"a": leaf(0.25, 5), "b": leaf(0.25, 100)}), Node(children={"c": leaf(0.5, 100)})
    root = Node(children={"l": left, "r": right})
    root.close()
    spread(root, 100)
    assert [left.children[k].budget for k in "ab"] + [right.children["c"].budget] == [5, 45, 50]
    left.children["b"].capacity = 20
    root.close()
    spread(root, 100)
    assert [left.children[k].budget for k in "ab"] + [right.children["c"].budget] == [5, 20, 75]


def test_a_wide_tree_is_spread_in_no_time():
    import time

    rng = random.Random(5)
    root = Node(children={i: Node(rng.random(), rng.random() * 100) for i in range(50_000)})
    root.close()
    root.wanted = 1_000_000.0
    start = time.time()
    spread(root, 1_000_000.0)
    assert time.time() - start < 5 and abs(root.budget - 1_000_000) < 1
    level = [c.budget / c.weight for c in root.children.values() if c.budget < c.capacity - 1e-6]
    # children that aren't full have the same share of their weight, the full ones less
    assert max(level) - min(level) < 1e-3 * max(level)
    assert all(c.budget / c.weight <= max(level) + 1e-6 for c in root.children.values())


def test_two_levels_and_short_leaves(spark):
    rows = [(i, "a", "en" if i % 2 else "de", 10) for i in range(100)] + [(1000 + i, "b", "en", 10) for i in range(10)] + [(2000 + i, "b", "de", 10) for i in range(400)]
    items = spark.createDataFrame(rows, "doc bigint, source string, lang string, n bigint").repartition(4)
    weights = [("a", "en", 0.25, 1), ("a", "de", 0.25, 1), ("b", "en", 0.25, 2), ("b", "de", 0.25, 2)]
    made = mix(items, "doc", "n", ["source", "lang"], spark.createDataFrame(weights, "source string, lang string, w double, r bigint"), "w", "r", seed=1)
    report = {(r.source, r.lang): r for r in made.report.collect()}
    # b's English is short and b's German takes it over; what all of a lacks goes to b
    assert report["b", "en"].short and not report["b", "de"].short and report["a", "en"].short and report["a", "de"].short
    assert report["b", "en"].reached == 200 and report["b", "de"].budget == 5100 - 1000 - 200 == report["b", "de"].reached
    assert {r.wanted for r in report.values()} == {1275.0}
    with pytest.raises(ValueError):
        mix(items, "doc", "n", ["source", "lang"], spark.createDataFrame(weights + weights[:1], "source string, lang string, w double, r bigint"), "w", "r")


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["big", "big", "big", "small", "other", None]), rng.choice([0, 10, 30, None]), "x") for i in range(4000)] + [(5000 + i, "tiny", 10, "x") for i in range(3)] + [(None, "big", 10, "x")]
    items = spark.createDataFrame(rows, "doc bigint, source string, n bigint, uses string").repartition(5)
    weights = spark.createDataFrame([("big", 0.3, 2), ("small", 0.4, 3), ("tiny", 0.2, 4), ("none", 0.1, 5)], "source string, w double, r bigint")
    made = mix(items, "doc", "n", ["source"], weights, "w", "r", seed=7)
    total = sum(n or 0 for _, _, n, _ in rows)
    report = {r.source: r for r in made.report.collect()}
    assert report["tiny"].short and report["none"].short and not report["big"].short
    assert report["tiny"].reached == 4 * 30 and report["none"].reached == 0
    used = made.items.collect()
    assert len(used) == len(rows)
    for s in ("big", "small", "tiny"):
        mine = [r for r in used if r.source == s]
        assert max(r.uses for r in mine) - min(r.uses for r in mine) <= 1 and max(r.uses for r in mine) <= report[s].max_repeats
        assert report[s].budget - 30 <= sum(r.uses * r["size"] for r in mine) <= report[s].budget
    assert all(r.uses == 0 for r in used if r.source in (None, "other"))
    assert abs(sum(r.reached for r in report.values()) - min(total, sum(r.max_repeats * r.tokens for r in report.values()))) <= 90
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    again = {(r.id, r.uses) for r in mix(items.repartition(2), "doc", "n", ["source"], weights, "w", "r", seed=7).items.collect()}
    assert again == {(r.id, r.uses) for r in used}
    nothing = mix(items.limit(0), "doc", "n", ["source"], weights, "w", "r")
    assert nothing.items.count() == 0 and nothing.report.count() == 4


# 7 to 9: tokens


@needs_vocabulary
def test_counts_equal_whole_encoding(sf_dir, spark):
    counts = counter(DEFAULT_VOCABULARY)
    rng = random.Random(12)
    letters, mixed = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    long = ["internationalization" * 1000, letters * 770, "".join(rng.choices(mixed, k=50_000)), "x" * 300_000, "a" + "=" * 100_000, "語" * 50_000, "".join(rng.choices(letters, k=100_000)) + " a"]
    texts = ODD_TEXTS + long + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r.text]
    assert [counts.count(t) for t in texts] == [len(counts.encoding.encode_ordinary(t)) for t in texts]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "id int, text string")
    assert sorted(map(tuple, token_counts(df, {"id": F.col("id")}, "text").collect())) == [(1, 0), (2, 0), (3, 2), (3, 2)]


@needs_vocabulary
def test_another_vocabulary_of_the_same_name(spark, tmp_path):
    other = tmp_path / os.path.basename(DEFAULT_VOCABULARY)
    # single bytes alone: every byte is a token
    other.write_text("".join(line for line in open(DEFAULT_VOCABULARY) if int(line.split()[1]) < 256))
    df = spark.createDataFrame([(1, "some words")], "id int, text string")
    counted = [token_counts(df, {"id": F.col("id")}, "text", v).collect()[0].n_tokens for v in (DEFAULT_VOCABULARY, str(other), DEFAULT_VOCABULARY)]
    assert counted == [2, 10, 2]


@needs_vocabulary
def test_texts_are_packed(spark):
    df = spark.createDataFrame([(i, "word " * (i * 7)) for i in range(60)] + [(99, None)], "id bigint, text string")
    packs = pack_texts(df, "id", "text", 100)
    assert {r.id for r in packs.collect()} == {*range(60), 99} and packs.groupBy("pack_id").sum("size").agg({"sum(size)": "max"}).collect()[0][0] <= 100


@needs_vocabulary
@pytest.mark.parametrize("limit,overlap", [(512, 64), (40, 0), (20, 5), (90, 16)])
def test_pieces(sf_dir, spark, limit, overlap):
    counts = counter(DEFAULT_VOCABULARY)
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    for text in texts:
        pieces = split_text(text, limit, overlap, counts)
        assert "".join(text[a:b] for _, a, b, *_ in pieces) == (text or "")
        last = 0
        for k, (start, new, end, n, shared, cut, forced) in enumerate(pieces):
            assert n == counts.count(text[start:end]) <= limit
            assert last <= start <= new < end or (k == 0 and start == new == 0)
            assert not overlap or k == 0 or shared <= overlap + 16
            assert (cut == "end") == (k == len(pieces) - 1)
            last = start
        stretch = max((counts.count(w) for w in re.findall(r"\S+", text or "") if len(w.encode()) > limit), default=0)
        assert any(f for *_, f in pieces) == (stretch > limit)


@needs_vocabulary
def test_overlaps_reach_past_short_pieces():
    counts = counter(DEFAULT_VOCABULARY)
    rng = random.Random(8)
    section = lambda n: "# Part\n\n" + "".join("some plain words stand here\n" for _ in range(n)) + "\n"
    crafted = "".join(section(n) for n in (68, 1, 68, 2, 1, 68))
    mixed = "".join(section(rng.choice([1, 2, 5, 66, 68, 70])) for _ in range(120))
    for text in (crafted, mixed):
        pieces = split_text(text, 512, 64, counts)
        assert "".join(text[a:b] for _, a, b, *_ in pieces) == text
        for before, (start, new, end, n, shared, *_) in zip(pieces, pieces[1:]):
            assert n == counts.count(text[start:end]) <= 512 and shared == counts.count(text[start:new])
            assert before[0] <= start and (64 <= shared <= 80 or start == before[0])


@needs_vocabulary
def test_cuts_follow_the_structure():
    counts = counter(DEFAULT_VOCABULARY)
    section = lambda i: f"# Part {i}\n\n" + "Some plain words stand here. " * 8 + "\n\n- one\n- two\n"
    pieces = split_text("".join(map(section, range(6))), 90, 0, counts)
    assert len(pieces) > 2 and all(p[5] in ("heading", "end") for p in pieces)
    assert tree_chunks([5, 5, 5, 5], [0, 9, 0, 9], 10) == [(0, 2), (2, 4)]
    assert tree_chunks([30], [0], 10) == [(0, 1)]
    # what is left of an opened section is not joined with the next one, nor with the start of a section that is opened
    assert tree_chunks([8, 8, 4, 3], [0, 6, 6, 0], 10) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert tree_chunks([3, 8, 8, 1, 1], [0, 0, 6, 0, 0], 10) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert tree_chunks([8, 8, 4], [0, 6, 6], 10, 16) == [(0, 2), (2, 3)]


@needs_vocabulary
@pytest.mark.parametrize("limit,overlap", [(512, 64), (90, 16)])
def test_no_piece_holds_a_stronger_boundary_than_one_cut_within_it(sf_dir, spark, limit, overlap):
    from arborlake.llm.splitting import _line_units

    counts = counter(DEFAULT_VOCABULARY)
    rng = random.Random(6)
    made = "".join(rng.choice(["# A\n\n", "## B\n", "text of some words\n", "\n", "- one\n", "  - two\n", "    more\n", "</ul>\n"]) for _ in range(4000))
    for text in [made] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r.text]:
        at, ranks = 0, {}
        for unit, _, rank in _line_units(text, counts):
            ranks[at] = rank
            at += len(unit)
        pieces = split_text(text, limit, overlap, counts)
        for _, new, end, *_ in pieces:
            inside = min((r for a, r in ranks.items() if new < a < end), default=99)
            for edge in (new, end):
                if 0 < edge < len(text):
                    # a cut is at least as strong as all boundaries that the piece holds
                    assert ranks.get(edge, 99) <= inside, text[new:end]


def test_lists_nest_by_their_indent():
    from arborlake.llm.splitting import ITEM, LINE, PARAGRAPH, _item_rank, _line_units

    text = "# H\n\nIntro\n- a\n  - b\n    - c\n\n      of c\n  - d\n- e\n\n  of e\n\nAfter\n<ul>\n<li>x\n</ul>\nEnd\n"
    got = [(u.strip(), r) for u, _, r in _line_units(text, type("N", (), {"count": staticmethod(len)})()) if u.strip()]
    assert got == [
        ("# H", 0), ("Intro", PARAGRAPH), ("- a", ITEM), ("- b", _item_rank(1)), ("- c", _item_rank(2)), ("of c", _item_rank(3)), ("- d", _item_rank(1)), ("- e", ITEM),
        ("of e", _item_rank(1)), ("After", PARAGRAPH), ("<ul>", LINE), ("<li>x", ITEM), ("</ul>", LINE), ("End", PARAGRAPH),
    ]


@needs_vocabulary
def test_split_table(spark):
    df = spark.createDataFrame([(1, "a " * 300, 5), (1, "a " * 300, 5), (2, None, 5), (3, "", 5), (4, "  ", 5)], "id int, text string, piece int")
    out = split_texts(df, {"id": F.col("id")}, "text", 100, 10).collect()
    assert {r.id for r in out} == {1, 4} and all(r.n_tokens <= 100 for r in out)
    assert split_texts(df.limit(0), {"id": F.col("id")}, "text", 100, 10).count() == 0
    assert "text" not in split_texts(df, {"id": F.col("id")}, "text", 100, 10, with_text=False).columns
    with pytest.raises(ValueError):
        split_texts(df, {"id": F.col("id")}, "text", 10, 10)
