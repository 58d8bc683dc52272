"""Components: discovery below folders, attribution of files, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import ancestors, basename, json_value
from arborlake.plans import rules as R


def leaves_only(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path has no other path of the same repository below it (self anti-join through exploded ancestors)."""
    above = paths.select("repo_id", F.explode(ancestors(F.col(path))).alias(path)).distinct()
    return paths.join(above, ["repo_id", path], "left_anti")


def owner_of(files: DataFrame, path: str, components: DataFrame) -> DataFrame:
    """``repo_id``, ``path`` of each distinct file and ``component``, the deepest component that encloses it.

    Longest-prefix join: the file's ancestors are joined by equality, so no
    pair of file and component is tried.  Files within no component are left
    out; backslashes count as slashes.
    """
    norm = F.translate(path, "\\", "/")
    tried = files.select("repo_id", F.col(path).alias("_path"), F.explode(F.concat(ancestors(norm), F.array(norm))).alias("component"))
    own = components.select("repo_id", F.col("path").alias("component")).distinct()
    hits = tried.join(own, ["repo_id", "component"])
    return hits.groupBy("repo_id", "_path").agg(F.max_by("component", F.length("component")).alias("component")).withColumnRenamed("_path", path)


def discovered(files: DataFrame) -> DataFrame:
    """Every folder at least two levels down with a manifest and no such folder below it.

    ``repo_id, parent`` (the top folder), ``path, name, description, manifest_path, manifest_name``.
    """
    known = F.array(*map(F.lit, R.COMPONENT_MANIFESTS))
    exts = F.array(*map(F.lit, R.COMPONENT_EXTENSIONS))
    rows = files.filter(~F.col("is_secondary") & (F.col("name").isin(*R.COMPONENT_MANIFESTS) | F.col("ext").isin(*R.COMPONENT_EXTENSIONS)) & (F.size("segments") >= 3))
    by_name = F.array_position(known, F.col("name"))
    rank = F.when(by_name > 0, by_name).otherwise(100 + F.array_position(exts, F.col("ext")))
    folder = F.array_join(F.slice("segments", 1, F.size("segments") - 1), "/")
    named = rows.select("repo_id", folder.alias("path"), rank.alias("rank"), "relative_path", "name", F.when(F.col("name") == "package.json", F.col("content")).alias("content"))
    best = named.groupBy("repo_id", "path").agg(F.min_by(F.struct("relative_path", "name", "content"), F.struct("rank", "relative_path")).alias("m"))
    leaf = leaves_only(best)
    json = json_value(F.col("m.content"))
    own = lambda member: F.nullif(F.try_variant_get(json, f"$.{member}", "string"), F.lit(""))
    return leaf.select(
        "repo_id", F.get(F.split("path", "/"), F.lit(0)).alias("parent"), "path", F.coalesce(own("name"), basename(F.col("path"))).alias("name"), own("description").alias("description"),
        F.col("m.relative_path").alias("manifest_path"), F.col("m.name").alias("manifest_name"),
    )


def component_kind(kind: Column, path: Column, name: Column, manifest_path: Column) -> Column:
    """A valid explicit kind, else by folder, by name, 'package' with a manifest, else null."""
    out = F.when(kind.isin(*R.KINDS), kind)
    for pattern, value in R.KIND_BY_PATH:
        out = out.when(path.rlike(pattern), value)
    low = F.lower(F.coalesce(name, F.lit("")))
    out = out.when(low.rlike("server|api|gateway"), "service").when(low.rlike("web|frontend|dashboard"), "app")
    return out.when(F.coalesce(manifest_path, F.lit("")) != "", "package")


def classified(hints: DataFrame) -> DataFrame:
    """One component per repository and path: the first hint, by stage, rule and sub where there are such or else by ``ord``, that has a kind.

    Result: ``repo_id, path, name, kind, description``.  Copies of a hint and
    hints that can't be classified don't matter; backslashes are slashes.
    """
    path = F.translate("path", "\\", "/")
    order = F.struct("stage", "rule", "sub") if "stage" in hints.columns else F.col("ord")
    rows = hints.select("repo_id", order.alias("ord"), path.alias("path"), "name", "description", component_kind(F.col("kind"), path, F.col("name"), F.col("manifest_path")).alias("kind"))
    first = rows.filter("kind is not null and path is not null").groupBy("repo_id", "path")
    # ties of ``ord`` are settled by the content, so that the pick is the same on every run
    picked = first.agg(F.min(F.struct("ord", F.coalesce("name", basename(F.col("path"))).alias("name"), "kind", F.nullif("description", F.lit("")).alias("description"))).alias("c"))
    return picked.select("repo_id", "path", "c.name", "c.kind", "c.description")


def secondary_kinds(components: DataFrame, files: DataFrame) -> DataFrame:
    """``components`` with ``secondary_kinds``: roles that files anywhere below suggest, beside the component's own kind."""
    name = F.col("name")
    starts = lambda prefixes: name.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")
    signs = {"app": name.isin(*R.APP_FILES) | starts(R.APP_PREFIXES), "service": name.isin(*R.SERVICE_FILES), "package": starts(R.PACKAGE_PREFIXES)}
    telling = files.filter(signs["app"] | signs["service"] | signs["package"])
    flags = telling.select("repo_id", F.explode(ancestors(F.col("relative_path"))).alias("path"), *(v.cast("int").alias(f"is_{k}") for k, v in signs.items()))
    per = flags.join(components.select("repo_id", "path"), ["repo_id", "path"], "left_semi").groupBy("repo_id", "path").agg(*(F.max(f"is_{k}").alias(f"is_{k}") for k in signs))
    kinds = F.array_compact(F.array(*(F.when(F.col(f"is_{k}") == 1, F.lit(k)) for k in signs)))
    joined = components.join(per, ["repo_id", "path"], "left")
    return joined.withColumn("secondary_kinds", F.array_sort(F.array_except(kinds, F.array("kind")))).drop(*(f"is_{k}" for k in signs))
