"""Queries over payloads of nested scan results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.model import COMPONENT, ENTRY, RESULT, SCOPE
from arborlake.operators.nested import flat_table, shred_records
from arborlake.runtime import read


def _nodes(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return shred_records(read(spark, sf_dir, "raw_scans").filter("raw_id is not null"), ["raw_id"], "payload", RESULT, [table])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _nodes(spark, sf_dir, ENTRY.name).filter(F.col("parent_table") == SCOPE.name).dropDuplicates(["raw_id", "row_id"])
    return entries.select(
        "raw_id",
        F.col("top_key").alias("root_path"),
        F.when(F.col("depth") > 2, F.col("above_key")).otherwise("").alias("parent_path"),
        F.col("owner_key").alias("component_path"),
        F.get("values", F.lit(0)).alias("language"),
    )


def p3_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_nodes(spark, sf_dir, RESULT.name), ["raw_id"], RESULT)


def p3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_nodes(spark, sf_dir, COMPONENT.name), ["raw_id"], COMPONENT)


def p3_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_nodes(spark, sf_dir, SCOPE.name), ["raw_id"], SCOPE)


def p3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_table(_nodes(spark, sf_dir, ENTRY.name), ["raw_id"], ENTRY)


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of components with what the rows they name as parents say: entry, scope and component joined by their ids."""
    nodes = shred_records(read(spark, sf_dir, "raw_scans").filter("raw_id is not null"), ["raw_id"], "payload", RESULT)
    table = lambda shape: flat_table(nodes, ["raw_id"], shape)
    entries = table(ENTRY).filter(F.col("parent_table") == SCOPE.name).select("raw_id", F.col("parent_id").alias("scope_id"), "language", "files", "lines")
    scopes = table(SCOPE).select("raw_id", F.col("row_id").alias("scope_id"), F.col("parent_id").alias("component_id"))
    components = table(COMPONENT).select("raw_id", F.col("row_id").alias("component_id"), F.col("path").alias("component_path"), "kind")
    return entries.join(scopes, ["raw_id", "scope_id"]).join(components, ["raw_id", "component_id"]).select("raw_id", "component_path", "kind", "language", "files", "lines")


QUERIES = {f.__name__: f for f in (p3_found, p3_results, p3_components, p3_scopes, p3_entries, p3_links)}


def _readable(text: str) -> str:
    """A text as JSON, strictly or without commas before closing signs."""
    mended = f"regexp_replace({text}, ',(\\s*[}}\\]])', '\\1', 'g')"
    return f"case when json_valid({text}) then {text}::json when json_valid({mended}) then {mended}::json end"


def _held(value: str) -> str:
    """What a JSON string holds, the value itself otherwise."""
    return f"case when json_type({value}) = 'VARCHAR' then {_readable(f'({value} ->> chr(36))')} else {value} end"


def _get(value: str, name: str) -> str:
    snake = "".join("_" + c.lower() if c.isupper() else c for c in name)
    return f"({value} -> '$.{name}')" if snake == name else f"coalesce({value} -> '$.{name}', {value} -> '$.{snake}')"


def _entries_sql() -> str:
    """All entries of components by a recursion over the JSON values, which knows nothing of triples or shapes."""
    names = ("rootPath", "scannedAt", "inventory", "architecture", "languageStats")
    both = [x for n in names for x in (n, "".join("_" + c.lower() if c.isupper() else c for c in n))]
    told = "[" + ", ".join(f"'{x}'" for x in dict.fromkeys(both)) + "]"
    text = lambda value, name: f"({_get(value, name)} ->> chr(36))"
    result = lambda v: f"json_type({v}) = 'OBJECT' and list_has_any(json_keys({v}), {told})"
    held = f"case w.kind when 'w' then w.v when 'r' then {_get(_get('w.v', 'architecture'), 'components')} else {_get('w.v', 'components')} end"
    return f"""with recursive p as (select raw_id, any_value(payload) as payload from raw_scans where raw_id is not null and payload is not null group by raw_id),
t1 as (select raw_id, {_readable("payload")} as v from p), t2 as (select raw_id, {_held("v")} as v from t1), t3 as (select raw_id, {_held("v")} as v from t2),
rec as (select raw_id, kind, v, {text("v", "rootPath")} as root_path, null::varchar as parent_path, null::varchar as path from t3, (values ('w'), ('r')) k(kind) where v is not null and (kind = 'w' or {result("v")})
 union all
 select w.raw_id, n.kind, e.value, case n.kind when 'r' then {text("e.value", "rootPath")} else w.root_path end, case w.kind when 'c' then w.path else '' end,
 coalesce({text("e.value", "path")}, case when w.listed = 'OBJECT' then e.key end)
 from (select *, {held} as inner_v, json_type({held}) as listed from rec w) w, json_each(w.inner_v) e, (values ('w'), ('r'), ('c')) n(kind)
 where w.listed in ('OBJECT', 'ARRAY') and case when w.kind <> 'w' then n.kind = 'c' and json_type(e.value) = 'OBJECT'
 else json_type(e.value) in ('OBJECT', 'ARRAY') and (w.listed = 'ARRAY' or not list_contains({told}, e.key)) and (n.kind = 'w' or n.kind = 'r' and {result("e.value")}) end),
s1 as (select *, {_held(_get("v", "scoped"))} as scoped from rec where kind = 'c'), s2 as (select *, {_held(_get("scoped", "languageStats"))} as stats from s1), s3 as (select *, {_get("stats", "perLanguage")} as per from s2),
entries as (select s3.raw_id, s3.root_path, s3.parent_path, s3.path as component_path, s3.v as component, coalesce({text("e.value", "language")}, case when json_type(per) = 'OBJECT' then e.key end) as language, e.value as entry
 from s3, json_each(per) e where json_type(per) = 'OBJECT' or json_type(per) = 'ARRAY' and json_type(e.value) = 'OBJECT')
"""


SQL = {
    "p3_found": _entries_sql() + "select raw_id, root_path, parent_path, component_path, language from entries",
    "p3_links": _entries_sql()
    + "select raw_id, component_path, component ->> '$.kind' as kind, language, try_cast(entry ->> '$.files' as bigint) as files, try_cast(entry ->> '$.lines' as bigint) as lines from entries",
}
