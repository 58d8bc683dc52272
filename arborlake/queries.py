"""The registered queries over files, findings and stored reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import line_count
from arborlake.functions.paths import extension, is_secondary
from arborlake.operators import components as C
from arborlake.operators import ignore as I
from arborlake.operators.rulejoin import by_name
from arborlake.plans import aggregate as A
from arborlake.plans import detectors as D
from arborlake.plans import monorepo as M
from arborlake.plans import rules as R
from arborlake.runtime import clean, keep, one_per_key, read
from arborlake.sources import lookup as L
from arborlake.sources.vfiles import virtual_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_STAGE = ("repo_id", "value", "confidence", "evidence", "file_path")


def _register(name: str, build: Callable[[DataFrame, DataFrame], DataFrame], often: bool = False) -> None:
    """A query over the virtual files: ``build`` gets the reachable and the raw ones; those that are read ``often`` are kept."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = keep(D.compact(virtual_files(spark, sf_dir))) if often else virtual_files(spark, sf_dir)
        return build(I.walkable(raw), raw)

    query.__name__ = name
    QUERIES[name] = query


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("stage", "rule", "sub")})


def _flat(findings: DataFrame) -> DataFrame:
    return _placed(findings).select("stage", "rule", "sub", "repo_id", "value", "confidence", F.array_join("evidence", "; ").alias("evidence"), "file_path")


def _versions(hits: DataFrame) -> DataFrame:
    return hits.select("repo_id", F.col("value").alias("language"), "version", F.col("evidence").alias("source"), F.col("file_path").alias("relative_path"))


_register("virtual_files", lambda f, raw: raw.select("repo_id", "relative_path", "name", "ext", "content"))
_register("derived_columns", lambda f, raw: raw.select("repo_id", "relative_path", "name", "ext", F.size("segments").cast("bigint").alias("depth"), "is_secondary"))
_register("pruned_files", lambda f, raw: f.select("repo_id", "relative_path"))
_register("line_counts", lambda f, raw: f.select("repo_id", "relative_path", line_count(F.col("content")).alias("lines")))
_register("language_stats", lambda f, raw: D.language_stats(f).select("repo_id", "language", "files", "lines", "percentage", "total_files", "total_lines"))
_register("language_confidence", lambda f, raw: D.language_findings(f).withColumns({"evidence": F.array_join("evidence", "; "), "position": F.col("position").cast("bigint")}))
for _s in D.FRAMEWORK_STAGES:
    _register(_s.__name__, lambda f, raw, s=_s: s(f).select(*_STAGE))
for _s in (D.pm_lockfile, D.pm_manifest, D.pm_extension, D.pm_field, D.pm_pip):
    _register(_s.__name__, lambda f, raw, s=_s: s(f).select(*_STAGE))
for _s in (D.frameworks, D.package_managers, D.ci_providers, D.build_systems, D.containers):
    _register(_s.__name__, lambda f, raw, s=_s: _flat(s(f)))
for _s in D.RUNTIME_STAGES:
    _register(_s.__name__, lambda f, raw, s=_s: _versions(s(f)))
_register("runtimes", lambda f, raw: D.runtimes(f))
_register("python_signals", lambda f, raw: D.python_signal_folders(f))
_register("sln_projects", lambda f, raw: M.sln_projects(f).select("repo_id", "path", "name"))
_register("workspace_globs", lambda f, raw: _globs(M.pnpm_globs(f, raw), "pnpm").unionByName(_globs(M.npm_globs(raw).filter("glob is not null"), "npm")), often=True)
_register("go_work", lambda f, raw: M.go_work_uses(f, raw).withColumn("pos", F.col("pos").cast("bigint")))
_register("gradle_modules", lambda f, raw: _gradle(raw, "settings.gradle").unionByName(_gradle(raw, "settings.gradle.kts")))
_register("maven_modules", lambda f, raw: M.maven_modules(raw).withColumn("pos", F.col("pos").cast("bigint")))
_register("uv_members", lambda f, raw: M.uv_members(raw).withColumn("pos", F.col("pos").cast("bigint")))
_register("component_discovery", lambda f, raw: C.discovered(f))
_register("leaf_components", lambda f, raw: C.discovered(f).select("repo_id", "path"))
_register("component_hints_derived", lambda f, raw: _placed(M.component_hints(f, raw)).drop("kind"), often=True)
_register("components", lambda f, raw: C.classified(M.component_hints(f, raw)), often=True)
_register("secondary_kinds", lambda f, raw: C.secondary_kinds(_components(f, raw), f).select("repo_id", "path", "kind", F.coalesce(F.array_join("secondary_kinds", ","), F.lit("")).alias("secondary_kinds")), often=True)
_register("component_owner", lambda f, raw: C.owner_of(f, "relative_path", _components(f, raw)), often=True)
_register("component_languages", lambda f, raw: A.component_languages(f, _components(f, raw)).select("repo_id", "path", "language", "files", "lines", "percentage", "total_files", "total_lines"), often=True)
_register("component_frameworks", lambda f, raw: A.component_frameworks(D.frameworks(f), _components(f, raw)), often=True)
_register("monorepo_findings", lambda f, raw: M.monorepo_findings(f, raw), often=True)
_register("monorepo_flag", lambda f, raw: M.monorepo_flags(f, raw), often=True)
_register("inventory_flat", lambda f, raw: A.inventory_values(f))
_register("ignore_rules", lambda f, raw: I.ignore_rules(f).select("repo_id", F.col("ord").cast("bigint").alias("ord"), "pattern", "negated", "dir_only", "anchored"))
_register("ignore_verdicts", lambda f, raw: I.verdicts(f.select("repo_id", "relative_path"), I.ignore_rules(f), "relative_path"))
_register("pruned_folders", lambda f, raw: I.pruned_folders(f, I.ignore_rules(f)))
_register("indexed_files", lambda f, raw: I.indexed_files(raw).select("repo_id", "relative_path"))
_register("files_matching", lambda f, raw: L.matching(f, "*.TOML").unionByName(L.matching(f, "Dockerfile")).select("repo_id", "relative_path"))
_register("ini_entries", lambda f, raw: L.ini_entries(L.with_name(f, "setup.cfg"), ["repo_id", "relative_path"], "content"))
_register("find_files", lambda f, raw: L.matching_any(f, ["package.json", "Dockerfile", "*.ts", "*.toml"]).select("repo_id", "relative_path"))
_register("files_under", lambda f, raw: L.under(f, "apps/web").select("repo_id", "relative_path"))
_register("repos_with", lambda f, raw: L.has_any(f, ["turbo.json", "*.sln"]))
_register("test_files", lambda f, raw: f.select("repo_id", "relative_path", L.is_test_file(F.col("name"), F.col("is_secondary")).alias("is_test"), L.is_generated_file(F.col("name"), F.col("relative_path")).alias("is_generated")))


def _components(files: DataFrame, raw: DataFrame) -> DataFrame:
    return C.classified(M.component_hints(files, raw))


def _globs(globs: DataFrame, tool: str) -> DataFrame:
    return globs.select("repo_id", F.lit(tool).alias("tool"), F.col("pos").cast("bigint").alias("pos"), F.col("glob").alias("pattern"))


def _gradle(raw: DataFrame, settings: str) -> DataFrame:
    return M.gradle_modules(raw, settings).select("repo_id", F.lit(settings).alias("settings"), F.col("pos").cast("bigint").alias("pos"), "path")


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@_query
def detector_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(R.DETECTORS)], "ord int, id string, description string")


def _as_json(report: DataFrame) -> DataFrame:
    """The parts of nested reports as JSON, without the time of the scan."""
    parts = {"inventory": "inventory", "architecture": "architecture", "languageStats": "language_stats"}
    return report.select("repo_id", *(F.to_json(c, {"ignoreNullFields": "false"}).alias(n) for c, n in parts.items() if c in report.columns))


@_query
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole nested report of every virtual repository, as JSON."""
    return _as_json(A.scan_results(virtual_files(spark, sf_dir)))


@_query
def scan_report_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of two detectors alone."""
    return _as_json(A.scan_results(virtual_files(spark, sf_dir), ["runtime", "language"]))


def _checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored files, one row per repository and path, with a derived extension where it is missing.

    Lines are counted before copies are removed, so only manifests' texts are ever shuffled.
    """
    files = read(spark, sf_dir, "files").select("repo_id", "relative_path", "name", F.lower(F.coalesce("ext", extension(F.col("name")))).alias("ext"), "segments", "content")
    files = files.withColumn("is_secondary", is_secondary(F.col("relative_path")))
    return one_per_key(D.compact(files), ["repo_id", "relative_path"])


def _checkout(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """A query over the stored files."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(_checkouts(spark, sf_dir))

    query.__name__ = name
    QUERIES[name] = query


for _n, _f in {"package_managers": D.package_managers, "ci_providers": D.ci_providers, "containers": D.containers}.items():
    _checkout(f"checkout_{_n}", lambda files, f=_f: _flat(f(files)))
_checkout("checkout_runtimes", D.runtimes)
_checkout("checkout_confidence", lambda files: D.language_findings(files).withColumns({"evidence": F.array_join("evidence", "; "), "position": F.col("position").cast("bigint")}))
_checkout("checkout_components", lambda files: C.classified(M.component_hints(files, files)))
_checkout("checkout_monorepos", lambda files: M.monorepo_flags(files, files))
_checkout("checkout_inventory", A.inventory_values)


@_query
def checkout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole nested report of every stored repository, as JSON."""
    return _as_json(A.scan_results(_checkouts(spark, sf_dir)))


@_query
def checkout_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.language_stats(_checkouts(spark, sf_dir)).select("repo_id", "language", "files", "lines", "percentage", "total_files", "total_lines")


@_query
def checkout_build_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_name(D.primary(_checkouts(spark, sf_dir)), R.BUILD_FILES).select("repo_id", "value").distinct()


@_query
def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finding of each repository, detector, value and file."""
    rows = one_per_key(read(spark, sf_dir, "findings").select("finding_id", "repo_id", "detector", "ord", clean(F.col("value")).alias("value"), "confidence", "file_path"), ["finding_id"])
    first = rows.groupBy("repo_id", "detector", "value", F.coalesce("file_path", F.lit("")).alias("_file")).agg(F.min(F.struct("ord", "finding_id", "confidence", "file_path")).alias("m"))
    return first.select("repo_id", "detector", "value", "m.file_path", "m.ord", "m.confidence")


@_query
def stored_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct values per repository and detector."""
    rows = read(spark, sf_dir, "findings").filter("value is not null").select("repo_id", "detector", clean(F.col("value")).alias("value")).distinct()
    return rows.groupBy("repo_id", "detector").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("values"))


@_query
def component_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hints as classified components."""
    hints = one_per_key(read(spark, sf_dir, "component_hints"), ["hint_id"])
    return C.classified(hints).select("repo_id", "path", "name", "kind", "description")


@_query
def stored_component_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three frameworks of each stored component and how many more there are."""
    scans = one_per_key(read(spark, sf_dir, "scan_results").select("scan_id", "architecture.components"), ["scan_id"])
    rows = scans.select("scan_id", F.explode("components").alias("c")).select("scan_id", "c.path", F.col("c.scoped.frameworks").alias("f"))
    more = F.concat(F.array_join(F.slice("f", 1, 3), ", "), F.lit(" +"), (F.size("f") - 3).cast("string"), F.lit(" more"))
    text = F.when(F.coalesce(F.size("f"), F.lit(-1)) <= 0, "(none)").when(F.size("f") <= 3, F.array_join("f", ", ")).otherwise(more)
    return rows.select("scan_id", "path", text.alias("summary"))


@_query
def share_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares as they are printed."""
    rows = one_per_key(read(spark, sf_dir, "language_entries").select("entry_id", "files", "percentage"), ["entry_id"]).filter("percentage is not null")
    plain = F.format_string("%.1f", "percentage")
    return rows.select("entry_id", F.when((F.col("files") > 0) & (F.col("percentage") < 0.1), "< 0.1").otherwise(F.lpad(plain, F.greatest(F.lit(5), F.length(plain)), F.lit(" "))).alias("share"))
