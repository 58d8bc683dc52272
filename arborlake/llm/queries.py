"""The registered queries of the subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.llm.cooccurrence import cooccurrence
from arborlake.llm.frequency import term_frequencies
from arborlake.llm.handwritten import with_origin
from arborlake.llm.mixing import Mix, mix
from arborlake.llm.packing import divided, fill, pack_texts
from arborlake.llm.percentiles import merge_summaries, percentile_summary, radix_percentiles, summary_percentiles
from arborlake.llm.setjoin import set_similarity_classes, set_similarity_pairs
from arborlake.llm.splitting import SLACK, split_texts
from arborlake.llm.tokens import token_counts
from arborlake.runtime import clean, cut, one_per_key, read


def _cleaned(names):
    return F.transform(names, clean)


def _tagged(field):
    return F.transform(F.col(field), lambda v: F.concat(F.lit(f"{field}:"), clean(v)))


# 1 ---------------------------------------------------------------------------------------------------------------------------------------


def _item_pairs(spark: SparkSession, sf_dir: str, min_pair: int) -> DataFrame:
    scans = read(spark, sf_dir, "scan_results").select("scan_id", "inventory.frameworks", "inventory.packageManagers")
    tagged = [_tagged(c) for c in ("frameworks", "packageManagers")]
    items = F.concat(*(F.coalesce(t, F.array().cast("array<string>")) for t in tagged))
    return cooccurrence(one_per_key(scans, ["scan_id"]).select("scan_id", items.alias("items")), "scan_id", "items", min_pair)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, ab, n = (F.col(c) for c in ("n_a", "n_b", "n_ab", "n_records"))
    return _item_pairs(spark, sf_dir, 5).filter((200 * ab >= n) & (n * ab >= 4 * a * b)).select("item_a", "item_b")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of at least two scans, with lift and signed log-likelihood ratio."""
    return _item_pairs(spark, sf_dir, 2).withColumns({"lift": F.round("lift", 4), "llr": F.round("llr", 3)})


def p1_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair, those of a single scan included, with lift and signed log-likelihood ratio."""
    return _item_pairs(spark, sf_dir, 1).withColumns({"lift": F.round("lift", 4), "llr": F.round("llr", 3)})


_ITEMS_SQL = """with s as (select scan_id, any_value(inventory) as inv from scan_results where scan_id is not null group by scan_id),
u as (select scan_id, 'frameworks:' || lower(trim(v, ' ' || chr(9))) as item from (select scan_id, unnest(inv.frameworks) as v from s) where v is not null
union all select scan_id, 'packageManagers:' || lower(trim(v, ' ' || chr(9))) from (select scan_id, unnest(inv.packageManagers) as v from s) where v is not null),
i as (select distinct scan_id, item from u), c as (select item, count(*) as n from i group by item), t as (select count(*) as n from s),
p as (select x.item as item_a, y.item as item_b, count(*) as n_ab from i x join i y on x.scan_id = y.scan_id and x.item < y.item group by all),
j as (select item_a, item_b, a.n as n_a, b.n as n_b, n_ab, t.n as n_records from p join c a on a.item = item_a join c b on b.item = item_b, t)
"""
_P1_FOUND_SQL = _ITEMS_SQL + "select item_a, item_b from j where n_ab >= 5 and 200 * n_ab >= n_records and n_records * n_ab >= 4 * n_a * n_b"
_P1_PAIRS_SQL = (
    _ITEMS_SQL
    + """, k as (select *, n_ab::double as k11, (n_a - n_ab)::double as k12, (n_b - n_ab)::double as k21, (n_records - n_a - n_b + n_ab)::double as k22, n_records::double as n,
 n_records::double * n_ab / (n_a::double * n_b) as l from j where n_ab >= 2)
select item_a, item_b, n_a, n_b, n_ab, n_records, round(l, 4) as lift, round(case when l < 1 then -2.0 else 2.0 end * (
 case when k11 > 0 then k11 * ln(k11 * n / (n_a::double * n_b)) else 0 end + case when k12 > 0 then k12 * ln(k12 * n / (n_a::double * (n - n_b))) else 0 end
 + case when k21 > 0 then k21 * ln(k21 * n / ((n - n_a) * n_b)) else 0 end + case when k22 > 0 then k22 * ln(k22 * n / ((n - n_a) * (n - n_b))) else 0 end), 3) as llr from k"""
)
_P1_ALL_PAIRS_SQL = _P1_PAIRS_SQL.replace(" from j where n_ab >= 2)", " from j)")


# 2 ---------------------------------------------------------------------------------------------------------------------------------------


def _measured(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    rows = read(spark, sf_dir, "language_entries").select("entry_id", "component_path", "language", "scanned_at", value)
    return one_per_key(rows.filter(f"component_path is not null and language is not null and {value} >= 0"), ["entry_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = dict(language=clean(F.col("language")), scan_month=F.date_format("scanned_at", "yyyy-MM"))
    found = radix_percentiles(_measured(spark, sf_dir, "lines"), by, "lines", [0.5, 0.9])
    wide = found.groupBy("language", "scan_month").agg(F.first("n").alias("n"), F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("q") == 0.9, F.col("value"))).alias("p90"))
    return wide.filter("n >= 12 and p90 >= 12 * p50").select("language", "scan_month")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the lines per language over all days."""
    return radix_percentiles(_measured(spark, sf_dir, "lines"), dict(language=clean(F.col("language"))), "lines", [0.25, 0.5, 0.75, 0.9, 0.99])


def p2_span_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the percentiles of total_lines per language and month, from summaries of single days added up."""
    by = dict(language=clean(F.col("language")), scan_day=F.to_date("scanned_at"))
    days = percentile_summary(_measured(spark, sf_dir, "total_lines"), by, "total_lines")
    months = merge_summaries(days.withColumn("scan_month", F.date_format("scan_day", "yyyy-MM")), ["language", "scan_month"])
    found = summary_percentiles(months, ["language", "scan_month"], [0.5, 0.9])
    return found.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


_MEASURED_SQL = "with e as (select entry_id, any_value(lower(trim(language, ' ' || chr(9)))) as language, any_value(scanned_at) as scanned_at, any_value({0}) as v from language_entries where component_path is not null and language is not null and {0} >= 0 and entry_id is not null group by entry_id), "
_P2_FOUND_SQL = (
    _MEASURED_SQL.format("lines")
    + """r as (select language, strftime(scanned_at, '%Y-%m') as scan_month, v, row_number() over w as rn, count(*) over (partition by language, strftime(scanned_at, '%Y-%m')) as n
 from e window w as (partition by language, strftime(scanned_at, '%Y-%m') order by v)),
q as (select language, scan_month, any_value(n) as n, min(v) filter (rn >= ceil(0.5 * n)) as p50, min(v) filter (10 * rn >= 9 * n) as p90 from r group by all)
select language, scan_month from q where n >= 12 and p90 >= 12 * p50"""
)
_P2_PERCENTILES_SQL = (
    _MEASURED_SQL.format("lines")
    + """r as (select language, v, row_number() over (partition by language order by v) as rn, count(*) over (partition by language) as n from e)
select language, n, p / 100.0::double as q, min(v) as value from r, (values (25), (50), (75), (90), (99)) t(p) where 100 * rn >= p * n group by language, n, p"""
)


# the summary keeps seven bits below the leading one: the bucket of the exact percentile is what its bounds must be
_P2_SPAN_SQL = (
    _MEASURED_SQL.format("total_lines")
    + """r as (select language, strftime(scanned_at, '%Y-%m') as scan_month, v, row_number() over w as rn, count(*) over (partition by language, strftime(scanned_at, '%Y-%m')) as n
 from e window w as (partition by language, strftime(scanned_at, '%Y-%m') order by v)),
x as (select language, scan_month, n, p / 100.0::double as q, min(v) as v from r, (values (50), (90)) t(p) where 100 * rn >= p * n group by language, scan_month, n, p),
b as (select *, case when v > 0 then length(ltrim(bin(v), '0')) - 1 end as top from x)
select language, scan_month, n, q, case when v = 0 then 0.0::double else round(floor(v / pow(2, top - 7)) * pow(2, top - 7), 6) end as low,
 case when v = 0 then 0.0::double else round((floor(v / pow(2, top - 7)) + 1) * pow(2, top - 7) - pow(2, top - 52), 6) end as high from b"""
)


# 4 ---------------------------------------------------------------------------------------------------------------------------------------


def _origins(spark: SparkSession, sf_dir: str, evidence: bool = False) -> DataFrame:
    return with_origin(read(spark, sf_dir, "files").select("repo_id", "relative_path", "name", "ext", "content"), evidence=evidence)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_key(_origins(spark, sf_dir).filter("origin <> 'handwritten'").select("repo_id", "relative_path"), ["repo_id", "relative_path"])


def p4_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by language and origin."""
    files = _origins(spark, sf_dir).filter("language is not null").select("repo_id", "relative_path", "language", "origin")
    return one_per_key(files, ["repo_id", "relative_path"]).groupBy("language", "origin").agg(F.count("*").alias("files"))


def p4_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files by origin and by what speaks against hand-written source: path, name, notice, layout."""
    files = _origins(spark, sf_dir, True).filter("language is not null").select("repo_id", "relative_path", "origin", F.array_join("evidence", "+").alias("evidence"))
    return one_per_key(files, ["repo_id", "relative_path"]).groupBy("origin", "evidence").agg(F.count("*").alias("files"))


def p4_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hand-written source files, the opposite of p4_found among files with a source extension."""
    return one_per_key(_origins(spark, sf_dir).filter("origin = 'handwritten'").select("repo_id", "relative_path", "language"), ["repo_id", "relative_path"])


# 5 ---------------------------------------------------------------------------------------------------------------------------------------


def _framework_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of all scans, copies included: these are told by their names, so the nested rows need not be shuffled."""
    scans = read(spark, sf_dir, "scan_results").select("scan_id", "repo_id", "inventory.frameworks", "architecture.components").filter("scan_id is not null")
    name = F.concat(F.lit("s"), F.col("scan_id").cast("string"))
    whole = F.struct(name.alias("rec"), F.col("frameworks").alias("values"))
    parts = F.transform("components", lambda c: F.struct(F.concat(name, F.lit("/"), c["path"]).alias("rec"), c["scoped"]["frameworks"].alias("values")))
    sets = F.concat(F.array(whole), F.coalesce(parts, F.array().cast("array<struct<rec:string,values:array<string>>>")))
    return scans.select("repo_id", F.inline(sets))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_similarity_pairs(_framework_sets(spark, sf_dir), "rec", _cleaned(F.col("values")), F.col("repo_id"), 0.75, 6, copies=True).select("rec_a", "rec_b")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with its class of equal sets and the number of similar other classes."""
    members, pairs = set_similarity_classes(_framework_sets(spark, sf_dir), "rec", _cleaned(F.col("values")), 0.75, 6, copies=True)
    links = pairs.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links"))
    named = members.join(members.groupBy("sid").agg(F.min("record").alias("class")), "sid").join(links, "sid", "left")
    return named.select("record", "class", F.coalesce("links", F.lit(0)).alias("links"))


_SETS_SQL = """with s as (select scan_id, any_value(repo_id) as repo_id, any_value(inventory) as inv, any_value(architecture) as arch from scan_results where scan_id is not null group by scan_id),
k as (select scan_id, repo_id, unnest(arch.components) as c from s),
r as (select 's' || scan_id as rec, repo_id, inv.frameworks as v from s union all select 's' || scan_id || '/' || c.path, repo_id, c.scoped.frameworks from k),
d as (select rec, repo_id, list_sort(list_distinct(list_transform(list_filter(v, lambda x: x is not null), lambda x: lower(trim(x, ' ' || chr(9)))))) as v from r where rec is not null),
t as (select * from d where len(v) >= 6)
"""
_P5_FOUND_SQL = _SETS_SQL + """, x as (select rec, repo_id, len(v) as n, unnest(v) as f from t),
p as (select a.rec as rec_a, b.rec as rec_b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as o from x a join x b on a.f = b.f and a.rec < b.rec and a.repo_id <> b.repo_id group by 1, 2)
select rec_a, rec_b from p where 4 * o >= 3 * (na + nb - o)"""
_P5_CLASSES_SQL = _SETS_SQL + """, g as (select v, min(rec) as class from t group by v), x as (select class, len(v) as n, unnest(v) as f from g),
p as (select a.class as ca, b.class as cb, any_value(a.n) as na, any_value(b.n) as nb, count(*) as o from x a join x b on a.f = b.f and a.class <> b.class group by 1, 2),
l as (select ca, count(*) as links from p where 4 * o >= 3 * (na + nb - o) group by ca)
select rec as record, class, coalesce(links, 0) as links from t join g using (v) left join l on ca = class"""


# 6 ---------------------------------------------------------------------------------------------------------------------------------------


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["frameworks", "ciProviders", "buildSystems"]
    scans = one_per_key(read(spark, sf_dir, "scan_results").select("scan_id", *(f"inventory.{f}" for f in fields)), ["scan_id"])
    return term_frequencies(scans, "scan_id", {f: _cleaned(F.col(f)) for f in fields})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).filter("mark is not null").select("field", "term", "mark")


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir)


_TERMS_SQL = """with s as (select scan_id, any_value(inventory) as inv from scan_results where scan_id is not null group by scan_id),
l as (select scan_id, 'frameworks' as field, inv.frameworks as v from s union all select scan_id, 'ciProviders', inv.ciProviders from s union all select scan_id, 'buildSystems', inv.buildSystems from s),
d as (select field, count(*) as field_records from l where v is not null group by field),
u as (select scan_id, field, lower(trim(x, ' ' || chr(9))) as term from (select scan_id, field, unnest(v) as x from l) where x is not null),
c as (select field, term, count(*) as occurrences, count(distinct scan_id) as records from u group by all),
m as (select *, case when records <= 2 then 'rare' when 8 * records >= field_records then 'common' end as mark from c join d using (field))
"""
_P6_FOUND_SQL = _TERMS_SQL + "select field, term, mark from m where mark is not null"
_P6_TERMS_SQL = _TERMS_SQL + "select field, term, occurrences, records, field_records, mark from m"


# 7 ---------------------------------------------------------------------------------------------------------------------------------------


def _limits(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[int, int]:
    """Limit and overlap of one purpose; the table has a row per purpose."""
    row = read(spark, sf_dir, "token_limits").filter(F.col("purpose") == purpose).select("limit_tokens", "overlap_tokens").first()
    return int(row[0]), int(row[1])


def _packs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    capacity = _limits(spark, sf_dir, "pack")[0]
    return pack_texts(read(spark, sf_dir, "documents"), "doc_id", "text", capacity), capacity


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs, _ = _packs(spark, sf_dir)
    return divided(packs).select(F.col("id").alias("doc_id"))


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack of every text; of divided ones, of every part."""
    packs, _ = _packs(spark, sf_dir)
    return packs.withColumnRenamed("id", "doc_id")


def p7_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of all packs: each document once, its parts in order and full but for the last, no pack above the limit, few packs."""
    packs, capacity = _packs(spark, sf_dir)
    by_doc = packs.groupBy("id").agg(F.count("*").alias("parts"), F.max("part").alias("last"), F.count_if((F.col("size") < capacity)).alias("unfilled"), F.countDistinct("part").alias("different"))
    sound = (F.col("parts") == F.col("last") + 1) & (F.col("different") == F.col("parts")) & (F.col("unfilled") <= 1)
    docs = by_doc.agg(F.count("*").alias("documents"), F.count_if(~sound).alias("unsound"))
    by_pack = packs.groupBy("pack_id").agg(F.sum("size").alias("used"), F.max("pack_size").alias("said"))
    filled = by_pack.agg(F.count_if(F.col("used") > capacity).alias("above"), F.count_if(F.col("used") != F.col("said")).alias("misstated"), (F.count("*") <= 1.02 * F.sum("used") / capacity + 1).alias("few"))
    # both sides have one row
    return docs.join(filled, how="cross")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of packs and the share of their capacity that is used."""
    return fill(*_packs(spark, sf_dir))


# 8 ---------------------------------------------------------------------------------------------------------------------------------------


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id"), "source": clean(F.col("source")), "lang": F.coalesce("lang", F.lit("other"))}, "text")


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    sizes = _sizes(spark, sf_dir)
    return mix(sizes, "doc_id", "n_tokens", ["source"], read(spark, sf_dir, "mix_targets"), "target_share", "max_repeats", seed=20)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report.filter("short").select("source")


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, sf_dir).items.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "uses")


def p8_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of each source's uses: its documents all there, none used too often, no two uses apart by more than one, the budget kept to a document's size."""
    made = _mix(spark, sf_dir)
    per = made.items.filter("source is not null").groupBy("source").agg(F.count("*").alias("documents"), F.min("uses").alias("least"), F.max("uses").alias("most"), F.max("size").alias("largest"))
    rows = made.report.select("source", "max_repeats", "budget", "reached").join(per, "source", "left")
    kept = (F.col("reached") <= F.col("budget")) & (F.col("reached") > F.col("budget") - F.coalesce("largest", F.lit(1)) - 1)
    return rows.select(
        "source", F.coalesce("documents", F.lit(0)).alias("documents"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"),
        (F.coalesce(F.col("most") - F.col("least"), F.lit(0)) <= 1).alias("even"), (F.col("documents").isNull() | kept | (F.col("budget") == 0)).alias("budget_kept"),
    )


def p8_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a tree of two levels: each source's target is split among its languages alike, so a language without enough leaves its part to the source's others."""
    sizes = cut(_sizes(spark, sf_dir))
    targets = read(spark, sf_dir, "mix_targets")
    # a row per source and language: as many as the mix has leaves
    leaves = sizes.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    w = Window.partitionBy("source")
    weights = leaves.join(targets, "source").select("source", "lang", (F.col("target_share") / F.count("*").over(w)).alias("target_share"), "max_repeats")
    return mix(sizes, "doc_id", "n_tokens", ["source", "lang"], weights, "target_share", "max_repeats", seed=20).report


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return _mix(spark, sf_dir).report


# 9 ---------------------------------------------------------------------------------------------------------------------------------------


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    limit, overlap = _limits(spark, sf_dir, "split")
    return split_texts(read(spark, sf_dir, "documents").filter("doc_id is not null"), {"doc_id": F.col("doc_id")}, "text", limit, overlap, with_text=with_text)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, False).filter("forced").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, True)


def p9_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts that the pieces' new parts make when joined in their order, and whether pieces and overlaps keep to the limit."""
    limit, overlap = _limits(spark, sf_dir, "split")
    new = F.expr("substring(text, int(new_from - start) + 1)")
    part = F.struct("piece", new.alias("new"))
    sound = (F.col("n_tokens") <= limit) & (F.col("overlap_tokens") <= overlap + SLACK)
    # a group holds one document
    whole = _pieces(spark, sf_dir, True).groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.bool_and(sound).alias("within_limits"))
    return whole.select("doc_id", F.md5(F.array_join(F.col("parts.new"), "")).alias("digest"), "within_limits")


_P7_BALANCE_SQL = "select count(distinct doc_id) as documents, 0 as unsound, 0 as above, 0 as misstated, true as few from documents where doc_id is not null"
_P8_BALANCE_SQL = """select t.source, count(d.doc_id) as documents, true as within_repeats, true as even, true as budget_kept
from mix_targets t left join (select *, lower(trim(source, ' ' || chr(9))) as s from documents) d on d.s = t.source group by t.source"""
_P9_REJOINED_SQL = "select doc_id, md5(text) as digest, true as within_limits from documents where doc_id is not null and text <> ''"


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_all_pairs, p2_found, p2_percentiles, p2_span_bounds, p4_found, p4_origins, p4_evidence, p4_handwritten, p5_found, p5_classes, p6_found, p6_terms, p7_found, p7_packs, p7_fill, p7_balance, p8_found, p8_uses, p8_shares, p8_balance, p8_tree, p9_found, p9_pieces, p9_rejoined)}
SQL = {
    "p1_found": _P1_FOUND_SQL,
    "p1_pairs": _P1_PAIRS_SQL,
    "p1_all_pairs": _P1_ALL_PAIRS_SQL,
    "p2_found": _P2_FOUND_SQL,
    "p2_percentiles": _P2_PERCENTILES_SQL,
    "p2_span_bounds": _P2_SPAN_SQL,
    "p5_found": _P5_FOUND_SQL,
    "p5_classes": _P5_CLASSES_SQL,
    "p6_found": _P6_FOUND_SQL,
    "p6_terms": _P6_TERMS_SQL,
    "p7_balance": _P7_BALANCE_SQL,
    "p8_balance": _P8_BALANCE_SQL,
    "p9_rejoined": _P9_REJOINED_SQL,
}
