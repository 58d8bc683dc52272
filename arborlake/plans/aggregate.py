"""The nested report: one row per repository, with the parts that were asked for."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators.components import classified, owner_of, secondary_kinds
from arborlake.operators.ignore import with_listed
from arborlake.plans import detectors as D
from arborlake.plans import monorepo as M
from arborlake.plans.rules import DETECTORS
from arborlake.runtime import keep

IDS = tuple(i for i, _ in DETECTORS)
_LISTS = (("framework", "frameworks"), ("packageManager", "packageManagers"), ("ciProvider", "ciProviders"), ("buildSystem", "buildSystems"), ("containerization", "containerization"))
_ENTRY = "array<struct<language:string,files:bigint,lines:bigint,percentage:double>>"


def selection(detectors: Iterable[str] | None) -> tuple[str, ...]:
    """The detectors to run, all for None; raises for unknown ids."""
    if detectors is None:
        return IDS
    wanted = tuple(dict.fromkeys(detectors))
    unknown = [d for d in wanted if d not in IDS]
    if unknown:
        raise ValueError(f"unknown detectors {', '.join(unknown)}; known are {', '.join(IDS)}")
    return wanted


def inventory_values(files: DataFrame, chosen: Sequence[str] = IDS, found: DataFrame | None = None) -> DataFrame:
    """Distinct ``repo_id, category, value`` of the plain lists of the inventory; ``found`` are findings that were made before."""
    names = [(d, category) for d, category in _LISTS if d in chosen]
    out = None
    if names:
        found = D.findings(files, [d for d, _ in names]) if found is None else found
        category = F.create_map(*(F.lit(x) for pair in names for x in pair))[F.col("detector")]
        out = found.select("repo_id", category.alias("category"), "value").filter("category is not null").distinct()
    if "language" in chosen:
        languages = D.by_extension(files, D.R.EXT_TO_LANGUAGE).select("repo_id", F.lit("languages").alias("category"), "value").distinct()
        out = languages if out is None else out.unionByName(languages)
    return out


def _empty(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def _stats(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``languageStats`` struct per key from rows of ``with_shares``; entries by falling share, then by name."""
    entry = F.struct((-F.col("percentage")).alias("o"), "language", "files", "lines", "percentage")
    per = df.groupBy(*keys).agg(F.first("total_files").alias("totalFiles"), F.first("total_lines").alias("totalLines"), F.array_sort(F.collect_list(entry)).alias("e"))
    entries = F.transform("e", lambda x: F.struct(x["language"].alias("language"), x["files"].alias("files"), x["lines"].alias("lines"), x["percentage"].alias("percentage")))
    return per.select(*keys, F.struct("totalFiles", "totalLines", entries.alias("perLanguage")).alias("languageStats"))


def _stats_or_empty(column: Column) -> Column:
    none = F.struct(F.lit(0).cast("bigint").alias("totalFiles"), F.lit(0).cast("bigint").alias("totalLines"), _empty(_ENTRY).alias("perLanguage"))
    return F.coalesce(column, none)


def component_languages(files: DataFrame, components: DataFrame) -> DataFrame:
    """Language statistics of the files whose deepest component each is: ``repo_id, path, language, files, lines, …``."""
    facts = D.file_languages(files)
    owned = facts.join(owner_of(facts, "relative_path", components), ["repo_id", "relative_path"])
    counted = owned.groupBy("repo_id", F.col("component").alias("path"), "language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    return D.with_shares(counted, ("repo_id", "path"))


def component_frameworks(findings: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct ``repo_id, path, framework`` of findings made in a component's files."""
    placed = findings.filter("file_path is not null").select("repo_id", "file_path", "value")
    owned = placed.join(owner_of(placed, "file_path", components), ["repo_id", "file_path"])
    return owned.select("repo_id", F.col("component").alias("path"), F.col("value").alias("framework")).distinct()


def component_rows(files: DataFrame, raw: DataFrame, chosen: Sequence[str] = IDS, frameworks: DataFrame | None = None) -> DataFrame:
    """One row per component: ``repo_id`` and the struct ``component`` with what was run on it."""
    # read four times below, and never larger than the components themselves
    components = keep(secondary_kinds(classified(M.component_hints(files, raw)), files))
    scoped: list[Column] = []
    rows = components
    if "framework" in chosen:
        sets = component_frameworks(D.frameworks(files) if frameworks is None else frameworks, components).groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))
        rows = rows.join(sets, ["repo_id", "path"], "left")
        scoped.append(F.coalesce("frameworks", _empty("array<string>")).alias("frameworks"))
    if "language" in chosen:
        rows = rows.join(_stats(component_languages(files, components), ("repo_id", "path")), ["repo_id", "path"], "left")
        scoped.append(_stats_or_empty(F.col("languageStats")).alias("languageStats"))
    seconds = F.when(F.size("secondary_kinds") > 0, F.col("secondary_kinds"))
    fields = ["path", "name", "kind", seconds.alias("secondaryKinds"), "description", *([F.struct(*scoped).alias("scoped")] if scoped else [])]
    return rows.select("repo_id", F.struct(*fields).alias("component"))


def scan_results(raw: DataFrame, detectors: Iterable[str] | None = None) -> DataFrame:
    """One nested row per repository of ``raw``; parts of detectors that weren't run are absent columns or fields.

    The texts are read once, into a table of the manifests' texts and all
    files' line counts, from which every detector works.  Nothing runs before
    the report is asked for.

    With a selection, a part that no chosen detector owns is left out; an empty
    selection leaves ``repo_id`` and ``scannedAt`` only.
    """
    chosen = selection(detectors)
    raw = keep(with_listed(D.compact(raw)))
    files = raw.filter("listed")
    wanted = [d for d in chosen if d in D.REGISTRY]
    found = keep(D.findings(files, wanted)) if wanted else None
    frameworks = found.filter("detector = 'framework'") if "framework" in chosen else None
    out = raw.select("repo_id").distinct()
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    columns: list[Column] = [F.col("repo_id"), stamp.alias("scannedAt")]
    inventory: list[Column] = []
    lists = [c for d, c in (("language", "languages"), *_LISTS) if d in chosen]
    if lists:
        # a pivot over fixed categories: one pass, one row per repository
        wide = inventory_values(files, chosen, found).groupBy("repo_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("value")))).alias(c) for c in lists))
        out = out.join(wide, "repo_id", "left")
        inventory += [F.coalesce(c, _empty("array<string>")).alias(c) for c in lists]
    if "runtime" in chosen:
        order = F.struct(F.collate("language", "UNICODE").alias("a"), F.collate("version", "UNICODE").alias("b"), "language", "version", "source")
        versions = D.runtimes_of(found).groupBy("repo_id").agg(F.array_sort(F.collect_list(order)).alias("r"))
        plain = F.transform("r", lambda x: F.struct(x["language"].alias("language"), x["version"].alias("version"), x["source"].alias("source")))
        out = out.join(versions.select("repo_id", plain.alias("runtimes")), "repo_id", "left")
        inventory.append(F.coalesce("runtimes", _empty("array<struct<language:string,version:string,source:string>>")).alias("runtimes"))
    if inventory:
        columns.append(F.struct(*inventory).alias("inventory"))
    if "monorepo" in chosen:
        rows = component_rows(files, raw, chosen, frameworks)
        order = F.struct(F.col("component.kind").alias("a"), F.collate("component.name", "UNICODE").alias("b"), F.col("component.path").alias("c"), "component")
        packed = rows.groupBy("repo_id").agg(F.array_sort(F.collect_list(order)).alias("c"))
        packed = packed.select("repo_id", F.transform("c", lambda x: x["component"]).alias("components"))
        flags = M.monorepo_flags(files, raw)
        out = out.join(flags, "repo_id", "left").join(packed, "repo_id", "left")
        none = _empty(packed.schema["components"].dataType.simpleString())
        columns.append(F.struct(F.coalesce("monorepo", F.lit(False)).alias("monorepo"), F.col("tool_name").alias("toolName"), F.coalesce("components", none).alias("components")).alias("architecture"))
    if "language" in chosen:
        out = out.join(_stats(D.language_stats(files), ("repo_id",)), "repo_id", "left")
        columns.append(_stats_or_empty(F.col("languageStats")).alias("languageStats"))
    return out.select(*columns)
