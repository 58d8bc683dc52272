"""The detectors: each takes the table of files and gives findings.

Files have ``repo_id, relative_path, name, ext, is_secondary, content``.  The
detectors are lists of stages; the stages of all detectors that are asked for
are evaluated in one pass.  Which files a stage looks at is told by name,
extension or folder, so that filter reaches the scan and texts are read for
manifests only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import ancestors, dirname, drop_lines, json_source, json_value, line_count, lines_of, readable, trim
from arborlake.operators.rulejoin import Stage, by_extension, each_found, each_rule, each_token, expand, first_wins, hit, let, prepared_by, rules_of
from arborlake.plans import rules as R

PATH = "relative_path"


def primary(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_secondary"))


#: Files whose text any rule reads; the texts of all others are only counted.
READ_NAMES = tuple(
    dict.fromkeys(
        [n for n, _ in R.SINGLE_VERSION_FILES] + [n for n, _, _ in R.MANIFESTS] + [*R.COMPONENT_MANIFESTS, "requirements.txt", "build.sbt", ".tool-versions", "mise.toml", ".mise.toml"]
        + ["settings.gradle", "settings.gradle.kts", "go.work", "pnpm-workspace.yaml", ".scanignore"]
    )
)
READ_EXTENSIONS = (".csproj", ".sln")
_JSON_NAMES = ("package.json", "composer.json")
#: Read whatever their size: JSON manifests have no limit.
UNLIMITED_NAMES = (*_JSON_NAMES, "pubspec.yaml")


def compact(files: DataFrame) -> DataFrame:
    """Files with ``lines`` and the ``content`` of those alone whose text is read: one pass over the texts for all detectors."""
    wanted = F.col("name").isin(*READ_NAMES) | F.col("ext").isin(*READ_EXTENSIONS)
    lines = F.col("lines") if "lines" in files.columns else line_count(F.col("content"))
    counted = F.when(F.col("ext").isin(*(e for e, _ in R.EXT_TO_LANGUAGE)), lines)
    return files.select("repo_id", "relative_path", "name", "ext", "segments", "is_secondary", counted.alias("lines"), F.when(wanted, F.col("content")).alias("content"))


@prepared_by
def _prepared(files: DataFrame) -> DataFrame:
    """The readable ``text`` of files that are read, and the ``json`` and its ``json_text`` of JSON manifests, which have no size limit."""
    read = F.col("name").isin(*READ_NAMES) | F.col("ext").isin(*READ_EXTENSIONS)
    out = files.withColumns({"text": F.when(read, readable(F.col("content"))), "json": F.when(F.col("name").isin(*_JSON_NAMES), json_value(F.col("content")))})
    return out.withColumn("json_text", F.when(F.col("json").isNotNull(), json_source(F.col("content"))))


def keys_of(json_text: Column, member: str) -> Column:
    """Member names of an object within a JSON text, in their order; empty if it is none."""
    return F.coalesce(F.json_object_keys(F.get_json_object(json_text, f"$.{member}")), F.array().cast("array<string>"))


def text_of(json: Column, path: str) -> Column:
    """A string member; null for other types."""
    value = F.try_variant_get(json, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(json, path, "string"))


def _named(*names: str) -> Callable[[], Column]:
    """Primary files of these names."""
    return lambda: ~F.col("is_secondary") & F.col("name").isin(*names)


def _suffixed(*exts: str) -> Callable[[], Column]:
    return lambda: ~F.col("is_secondary") & F.col("ext").isin(*exts)


def _keys(pairs: Iterable[tuple]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(k for k, *_ in pairs))


def _by_name(name: str, detector: str, number: int, pairs: Sequence[tuple[str, str]], confidence: float, prefix: str, placed: bool = True) -> Stage:
    def hits() -> Column:
        path = F.col(PATH)
        return each_rule(pairs, F.col("name"), lambda r: hit(number, r["value"], confidence, F.concat(F.lit(prefix), path), path if placed else None, r["rule"]))

    return Stage(name, detector, _named(*_keys(pairs)), hits)


# --- frameworks --------------------------------------------------------------------------------------------------------------------------


def _dependency(number: int, member: str, pairs: tuple, prefix: str) -> Column:
    found = lambda r, token, at: hit(number, r["value"], 0.95, F.concat(F.lit(prefix), token, F.lit(" in "), PATH), F.col(PATH), 0, at)
    return each_token(keys_of(F.col("json_text"), member), pairs, found)


def _python_hits() -> Column:
    # every key consists of word signs and '-', so it is a whole token between other signs
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_-]+"), F.lit(0)))
    place = F.when(F.col("name") == "pyproject.toml", 0).otherwise(1)
    found = lambda r: hit(3, r["value"], 0.9, F.concat(F.lit("Python dep: "), r["key"], F.lit(" in "), PATH), F.col(PATH), place, r["rule"])
    return let(tokens, lambda held: each_found(R.PYTHON_FRAMEWORKS, lambda k: F.array_contains(held, k), found))


def _indicator(name: str, number: int, names: tuple[str, ...], pairs: tuple, prefix: str, text: Callable[[], Column] = lambda: F.col("text")) -> Stage:
    def hits() -> Column:
        order = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
        found = lambda r: hit(number, r["value"], 0.95, F.concat(F.lit(prefix), r["key"], F.lit(" in "), PATH), F.col(PATH), order, r["rule"])
        return let(text(), lambda t: each_found(pairs, lambda k: t.contains(k), found))

    return Stage(name, "framework", _named(*names), hits)


def _without_module_line() -> Column:
    return drop_lines(F.col("text"), lambda line: ~F.startswith(F.regexp_replace(line, r"^\s+", ""), F.lit("module ")))


def _gem_hits() -> Column:
    found = lambda r: hit(6, r["value"], 1.0, F.concat(F.lit("Gemfile contains "), r["key"]), F.col(PATH), r["rule"])
    quoted = lambda k, sign: F.col("text").contains(F.concat(F.lit(sign), k, F.lit(sign)))
    return each_found(R.RUBY_FRAMEWORKS, lambda k: quoted(k, "'") | quoted(k, '"'), found)


def _dotnet_hits() -> Column:
    found = lambda r: hit(8, r["value"], 0.95, F.concat(F.lit(".NET reference: "), r["key"], F.lit(" in "), PATH), F.col(PATH), 0, r["rule"])
    return each_found(R.DOTNET_FRAMEWORKS, lambda k: F.col("text").contains(k), found)


framework_config = _by_name("framework_config", "framework", 1, R.CONFIG_FRAMEWORKS, 1.0, "config file: ")
framework_npm = Stage("framework_npm", "framework", _named("package.json"), lambda: _dependency(2, "dependencies", R.NPM_FRAMEWORKS, "npm dependency: "))
framework_python = Stage("framework_python", "framework", _named("pyproject.toml", "requirements.txt"), _python_hits)
framework_go = _indicator("framework_go", 4, ("go.mod",), R.GO_FRAMEWORKS, "Go dep: ", _without_module_line)
framework_rust = _indicator("framework_rust", 5, ("Cargo.toml",), R.RUST_FRAMEWORKS, "Rust crate: ")
framework_gem = Stage("framework_gem", "framework", _named("Gemfile"), _gem_hits)
framework_elixir = _indicator("framework_elixir", 7, ("mix.exs",), R.ELIXIR_FRAMEWORKS, "Elixir dep: ")
framework_dotnet = Stage("framework_dotnet", "framework", _suffixed(".csproj"), _dotnet_hits)
framework_jvm = _indicator("framework_jvm", 9, ("build.gradle", "build.gradle.kts", "pom.xml"), R.JVM_FRAMEWORKS, "JVM dep: ")
framework_php = Stage("framework_php", "framework", _named("composer.json"), lambda: _dependency(10, "require", R.PHP_FRAMEWORKS, "Composer dep: "))
framework_scala = _indicator("framework_scala", 11, ("build.sbt",), R.SCALA_FRAMEWORKS, "SBT dep: ")
FRAMEWORK_STAGES = (
    framework_config, framework_npm, framework_python, framework_go, framework_rust, framework_gem, framework_elixir, framework_dotnet, framework_jvm, framework_php, framework_scala,
)


# --- package managers --------------------------------------------------------------------------------------------------------------------


def _manifest_hits() -> Column:
    passed = F.filter(rules_of(R.MANIFESTS, F.col("name")), lambda r: r["pattern"].isNull() | F.coalesce(F.rlike(F.col("text"), r["pattern"]), F.lit(False)))
    return F.transform(passed, lambda r: hit(2, r["value"], 0.7, F.concat(F.lit("manifest: "), PATH), None, r["rule"]))


def _declared_hits() -> Column:
    def hits(declared: Column) -> Column:
        tool = F.lower(F.get(F.split(declared, "@"), F.lit(0)))
        return F.when(declared != "", each_rule(R.PACKAGE_MANAGER_FIELD, tool, lambda r: hit(4, r["value"], 0.7, F.concat(F.lit("manifest: "), PATH, F.lit(" packageManager="), declared))))

    return let(text_of(F.col("json"), "$.packageManager"), hits)


pm_lockfile = _by_name("pm_lockfile", "packageManager", 1, R.LOCKFILES, 1.0, "lockfile: ", placed=False)
pm_manifest = Stage("pm_manifest", "packageManager", _named(*_keys(R.MANIFESTS)), _manifest_hits)
_extension_hits = lambda: each_rule(R.MANIFEST_EXTENSIONS, F.col("ext"), lambda r: hit(3, r["value"], 0.7, F.concat(F.lit("manifest: "), PATH), None, r["rule"]))
_pm_extension = Stage("pm_extension", "packageManager", _suffixed(*_keys(R.MANIFEST_EXTENSIONS)), _extension_hits)
pm_field = Stage("pm_field", "packageManager", _named("package.json"), _declared_hits)


def pm_extension(files: DataFrame) -> DataFrame:
    """The first file of each of these extensions."""
    first = F.struct("at", "confidence", "evidence", "file_path")
    return _pm_extension(files).groupBy("repo_id", "rule", "value").agg(F.min(first).alias("f")).select("repo_id", "value", "f.*")


def python_signal_folders(files: DataFrame) -> DataFrame:
    """Folders where another Python package manager is in use."""
    rows = primary(files).filter(F.col("name").isin("pyproject.toml", *R.PYTHON_SIGNAL_FILES))
    text = readable(F.col("content"))
    signal = (F.col("name") != "pyproject.toml") | F.coalesce(text.rlike(f"{R.POETRY_RE}|{R.UV_RE}|{R.PIPENV_RE}"), F.lit(False))
    return rows.filter(signal).select("repo_id", dirname(PATH).alias("folder")).distinct()


_pip_files = Stage("pm_pip", "packageManager", _named("requirements.txt"), lambda: F.array(hit(5, F.lit("pip"), 0.7, F.concat(F.lit("manifest: "), PATH))))


def pm_pip(files: DataFrame) -> DataFrame:
    """Requirement files with no other manager's signal in their folder or above; the one stage that must look at other files, by an equi-join on ancestors."""
    hits = _pip_files(files)
    above = hits.select("repo_id", "at", F.explode(ancestors(F.col("at"), with_top=True)).alias("folder"))
    covered = above.join(python_signal_folders(files), ["repo_id", "folder"], "left_semi").select("repo_id", "at").distinct()
    return hits.join(covered, ["repo_id", "at"], "left_anti")


# --- CI, build systems, containers -------------------------------------------------------------------------------------------------------


def _by_folder(name: str, detector: str, pairs: tuple, prefix: str) -> Stage:
    """Once a repository and rule: the first file anywhere below the folder, tests and examples included."""
    inside = lambda k: F.startswith(F.col(PATH), F.concat(k, F.lit("/")))
    found = lambda r: hit(2, r["value"], 1.0, F.concat(F.lit(prefix), r["key"], F.lit("/")), F.col(PATH), r["rule"], scope=F.concat(F.lit("below "), r["key"]))

    def wanted() -> Column:
        out = F.lit(False)
        for k, _ in pairs:
            out = out | inside(F.lit(k))
        return out

    return Stage(name, detector, wanted, lambda: each_found(pairs, inside, found))


CI_STAGES = (_by_name("ci_file", "ciProvider", 1, R.CI_FILES, 1.0, "config file: "), _by_folder("ci_folder", "ciProvider", R.CI_FOLDERS, "config under: "))
BUILD_STAGES = (_by_name("build_file", "buildSystem", 1, R.BUILD_FILES, 1.0, "build file: "),)
CONTAINER_STAGES = (
    _by_name("container_file", "containerization", 1, R.CONTAINER_FILES, 1.0, "container file: "),
    *((_by_folder("container_folder", "containerization", R.CONTAINER_FOLDERS, "container config under: "),) if R.CONTAINER_FOLDERS else ()),
)


# --- runtimes ----------------------------------------------------------------------------------------------------------------------------


def _versions(hits: Column) -> Column:
    """Hits with a version."""
    return F.filter(hits, lambda h: h["version"] != "")


def _version(number: int, language: Column, version: Column, source: Column, rule: Column | int = 0, sub: Column | int = 0) -> Column:
    return hit(number, language, 1.0, source, F.col(PATH), rule, sub, version=trim(version))


def _matched(name: str, number: int, file: str, language: str, pattern: str, source: str) -> Stage:
    return Stage(name, "runtime", _named(file), lambda: _versions(F.array(_version(number, F.lit(language), F.regexp_extract("text", pattern, 1), F.lit(source)))))


def _alias(tool: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in R.TOOL_ALIASES for x in pair))[F.lower(tool)], tool)


def _single_hits() -> Column:
    first = F.get(lines_of(F.col("text")), F.lit(0))
    return _versions(each_rule(R.SINGLE_VERSION_FILES, F.col("name"), lambda r: _version(1, r["value"], first, F.col("name"), r["rule"])))


def _engine_hits() -> Column:
    entries = (_version(4, F.lit(v), text_of(F.col("json"), f"$.engines.{k}"), F.lit(f"package.json#engines.{k}"), 0, i) for i, (k, v) in enumerate(R.ENGINES))
    return _versions(F.array(*entries))


def _tool_hits() -> Column:
    # a comment ends where the text does: before a carriage return it is none
    parts = lambda line: F.split(trim(F.regexp_replace(line, R.TOOL_COMMENT_RE, "")), r"(?U)\s+")
    rest = lambda p: F.array_join(F.slice(p, 2, F.size(p)), " ")
    made = F.transform(lines_of(F.col("text")), lambda line, at: let(parts(line), lambda p: F.when(F.size(p) > 1, _version(7, _alias(F.get(p, F.lit(0))), rest(p), F.lit(".tool-versions"), 0, at))))
    return _versions(F.array_compact(made))


def _mise_hits() -> Column:
    # what follows the first header, up to the next one
    first = F.when(F.instr("text", "[tools]") > 0, F.expr("substring(text, instr(text, '[tools]') + 7)"))
    block = F.get(F.split(first, r"(?m)^\["), F.lit(0))
    order = F.when(F.col("name") == "mise.toml", 0).otherwise(1)
    pair = lambda b: F.arrays_zip(F.regexp_extract_all(b, F.lit(R.MISE_TOOL_RE), F.lit(1)).alias("tool"), F.regexp_extract_all(b, F.lit(R.MISE_TOOL_RE), F.lit(2)).alias("version"))
    made = let(block, lambda b: F.transform(pair(b), lambda p, at: _version(8, _alias(p["tool"]), p["version"], F.concat("name", F.lit("#tools."), p["tool"]), order, at)))
    return _versions(made)


runtime_single = Stage("runtime_single", "runtime", _named(*_keys(R.SINGLE_VERSION_FILES)), _single_hits)
runtime_go = _matched("runtime_go", 2, "go.mod", "Go", R.GO_VERSION_RE, "go.mod")
runtime_gemfile = _matched("runtime_gemfile", 3, "Gemfile", "Ruby", R.GEMFILE_RUBY_RE, "Gemfile#ruby")
runtime_engines = Stage("runtime_engines", "runtime", _named("package.json"), _engine_hits)
runtime_pyproject = _matched("runtime_pyproject", 5, "pyproject.toml", "Python", R.REQUIRES_PYTHON_RE, "pyproject.toml#requires-python")
runtime_cargo = _matched("runtime_cargo", 6, "Cargo.toml", "Rust", R.RUST_VERSION_RE, "Cargo.toml#rust-version")
runtime_tool_versions = Stage("runtime_tool_versions", "runtime", _named(".tool-versions"), _tool_hits)
runtime_mise = Stage("runtime_mise", "runtime", _named("mise.toml", ".mise.toml"), _mise_hits)
RUNTIME_STAGES = (runtime_single, runtime_go, runtime_gemfile, runtime_engines, runtime_pyproject, runtime_cargo, runtime_tool_versions, runtime_mise)


# --- all of them -------------------------------------------------------------------------------------------------------------------------

#: Stages of each detector; ``register`` adds to them.  A detector's stages look at one file at a time.
REGISTRY: dict[str, tuple[Stage, ...]] = {
    "framework": FRAMEWORK_STAGES,
    "packageManager": (pm_lockfile, pm_manifest, _pm_extension, pm_field),
    "ciProvider": CI_STAGES,
    "buildSystem": BUILD_STAGES,
    "containerization": CONTAINER_STAGES,
    "runtime": RUNTIME_STAGES,
}


def register(detector: str, stages: Sequence[Stage]) -> None:
    """Add a detector, or replace one, that ``findings`` runs along with the others."""
    REGISTRY[detector] = tuple(stages)


def findings(files: DataFrame, detectors: Iterable[str] | None = None) -> DataFrame:
    """The findings of the detectors, all registered ones by default, in one pass over the files.

    A text that a stage can't make sense of gives no hit there and takes nothing away from other files, stages or detectors.
    """
    chosen = [d for d in (REGISTRY if detectors is None else detectors) if d in REGISTRY]
    hits = expand(files, [s for d in chosen for s in REGISTRY[d]])
    return first_wins(hits.unionByName(pm_pip(files)) if "packageManager" in chosen else hits)


def frameworks(files: DataFrame) -> DataFrame:
    return findings(files, ["framework"])


def package_managers(files: DataFrame) -> DataFrame:
    return findings(files, ["packageManager"])


def ci_providers(files: DataFrame) -> DataFrame:
    return findings(files, ["ciProvider"])


def build_systems(files: DataFrame) -> DataFrame:
    return findings(files, ["buildSystem"])


def containers(files: DataFrame) -> DataFrame:
    return findings(files, ["containerization"])


def runtimes_of(found: DataFrame) -> DataFrame:
    """Runtime versions of each repository from findings, first source first: ``repo_id, language, version, source``."""
    place = F.struct("stage", "rule", "file_path", "sub", F.get("evidence", F.lit(0)).alias("source"))
    kept = found.filter("detector = 'runtime'").groupBy("repo_id", F.col("value").alias("language"), "version").agg(F.min(place).alias("p"))
    return kept.select("repo_id", "language", "version", F.col("p.source").alias("source"))


def runtimes(files: DataFrame) -> DataFrame:
    return runtimes_of(findings(files, ["runtime"]))


def runtime_findings(files: DataFrame) -> DataFrame:
    """Runtimes as findings whose value is the JSON text of the runtime."""
    found = findings(files, ["runtime"])
    return found.withColumn("value", F.to_json(F.struct(F.col("value").alias("language"), "version", F.get("evidence", F.lit(0)).alias("source")))).drop("version")


# --- languages ---------------------------------------------------------------------------------------------------------------------------


def file_languages(files: DataFrame) -> DataFrame:
    """``repo_id, relative_path, language, lines`` of every file with a known extension, tests and examples included."""
    hits = by_extension(files, R.EXT_TO_LANGUAGE)
    lines = F.col("lines") if "lines" in files.columns else line_count(F.col("content"))
    return hits.select("repo_id", "relative_path", F.col("value").alias("language"), lines.alias("lines"))


def share_of_files(files: Column, total: Column) -> Column:
    """Percentage with one digit, halves rounded up."""
    return F.floor(files.cast("double") / total * 1000 + 0.5) / 10


def with_shares(counted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Add ``total_files``, ``total_lines`` and ``percentage`` to rows of (keys, language, files, lines)."""
    # a window holds a row per language, however many files a repository has
    w = Window.partitionBy(*keys)
    out = counted.withColumns({"total_files": F.sum("files").over(w), "total_lines": F.sum("lines").over(w)})
    return out.withColumn("percentage", share_of_files(F.col("files"), F.col("total_files")))


def language_stats(files: DataFrame) -> DataFrame:
    """``repo_id, language, files, lines, percentage, total_files, total_lines``."""
    counted = file_languages(files).groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    return with_shares(counted, ("repo_id",))


def language_findings(files: DataFrame) -> DataFrame:
    """Languages by files, confirmed or added by manifests: ``repo_id, language, files, confidence, evidence`` and ``position``, the order by falling confidence, then name.

    One pass: a file may count for its extension's language and confirm one as a manifest.
    """
    main = ~F.col("is_secondary")
    none = F.expr("cast(null as struct<kind:int,rule:int,key:string>)")
    fact = lambda r, n, kind, key: F.struct(r["value"].alias("language"), F.lit(n).alias("n"), (none if kind is None else F.struct(F.lit(kind).alias("kind"), r["rule"].alias("rule"), key.alias("key"))).alias("m"))
    facts = [
        each_rule(R.EXT_TO_LANGUAGE, F.col("ext"), lambda r: fact(r, 1, None, None)),
        F.when(main, each_rule(R.MANIFEST_CONFIRMS, F.col("name"), lambda r: fact(r, 0, 1, F.col("name")))),
        F.when(main, each_rule(R.EXT_MANIFEST_CONFIRMS, F.col("ext"), lambda r: fact(r, 0, 2, F.col("ext")))),
    ]
    kind = "array<struct<language:string,n:int,m:struct<kind:int,rule:int,key:string>>>"
    telling = F.col("ext").isin(*_keys(R.EXT_TO_LANGUAGE), *_keys(R.EXT_MANIFEST_CONFIRMS)) | F.col("name").isin(*_keys(R.MANIFEST_CONFIRMS))
    rows = files.filter(telling).select("repo_id", F.inline(F.flatten(F.array_compact(F.array(*(f.cast(kind) for f in facts))))))
    # a set holds rules, so it is no larger than their table
    both = rows.groupBy("repo_id", "language").agg(F.sum("n").alias("n_files"), F.array_sort(F.collect_set("m")).alias("m"))
    n, m = F.col("n_files"), F.col("m")
    counted = n > 0
    bucket = F.when(n >= 10, 1.0).when(n >= 3, 0.8).otherwise(0.5)
    confidence = F.when(~counted, F.when(F.size(m) > 1, 1.0).otherwise(0.8)).when(F.size(m) > 0, 1.0).otherwise(bucket)
    seen = lambda x, i: F.when((i == 0) & ~counted, F.when(x["kind"] == 1, F.concat(F.lit("manifest file: "), x["key"])).otherwise(F.concat(x["key"], F.lit(" files found")))).otherwise(
        F.when(x["kind"] == 1, F.concat(F.lit("confirmed by "), x["key"])).otherwise(F.concat(F.lit("confirmed by "), x["key"], F.lit(" files")))
    )
    start = F.when(counted, F.array(F.concat(n.cast("string"), F.lit(" file(s) with matching extensions")))).otherwise(F.array().cast("array<string>"))
    out = both.select("repo_id", "language", n.alias("files"), confidence.alias("confidence"), F.concat(start, F.transform(m, seen)).alias("evidence"))
    # a window holds a repository's languages
    return out.withColumn("position", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("confidence"), "language")))
