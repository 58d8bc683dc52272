"""Workspace layouts: which tool, which components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import basename, dirname, json_value, lines_of, readable, trim
from arborlake.operators.components import discovered
from arborlake.operators.rulejoin import by_extension, by_name, let
from arborlake.plans import rules as R
from arborlake.plans.detectors import primary, text_of

_HINT = ("repo_id", "stage", "rule", "sub", "path", "name", "description", "manifest_path", "manifest_name")
_NO_TEXT = "cast(null as string)"
SLN, PNPM, GO_WORK, NPM, ELIXIR, GRADLE, GRADLE_KTS, MAVEN, UV, MELOS, CONVENTION = range(1, 12)


def root_texts(raw: DataFrame, name: str) -> DataFrame:
    """``repo_id, text`` of a file at the top, read past ignore rules."""
    rows = raw.filter(F.col("relative_path") == name).withColumn("text", readable(F.col("content")))
    return rows.filter("text is not null").select("repo_id", "text")


def having(files: DataFrame, name: str) -> DataFrame:
    """Repositories with a file of this name anywhere, tests and examples included."""
    return files.filter(F.col("name") == name).select("repo_id").distinct()


def _hints(df: DataFrame, number: Column | int, rule: Column | int, sub: Column | int, path: Column, name: Column, **more: Column) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    extra = [more.get(c, F.expr(_NO_TEXT)).alias(c) for c in ("description", "manifest_path", "manifest_name")]
    return df.select("repo_id", as_column(number).alias("stage"), as_column(rule).cast("int").alias("rule"), as_column(sub).cast("int").alias("sub"), path.alias("path"), name.alias("name"), *extra)


def sln_projects(files: DataFrame) -> DataFrame:
    rows = primary(files).filter(F.col("ext") == ".sln").withColumn("text", readable(F.col("content"))).filter("text is not null")
    both = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(R.SLN_PROJECT_RE), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "project"))))
    found = rows.select("repo_id", "relative_path", F.posexplode(both).alias("pos", "p"))
    folder = F.regexp_extract(F.translate(F.col("p")["project"], "\\", "/"), r"^(.*)/[^/]*$", 1)
    # several solutions of a repository are taken by path
    rank = F.dense_rank().over(Window.partitionBy("repo_id").orderBy("relative_path"))
    return _hints(found.withColumn("_rank", rank), SLN, F.col("_rank"), F.col("pos"), folder, F.col("p")["name"]).filter("path <> ''")


def pnpm_globs(files: DataFrame, raw: DataFrame) -> DataFrame:
    """``repo_id, pos, glob`` of the workspace file at the top."""
    lines = root_texts(raw, "pnpm-workspace.yaml").join(having(files, "pnpm-workspace.yaml"), "repo_id", "left_semi")
    lines = lines.select("repo_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "raw")).withColumn("line", F.regexp_replace("raw", R.PNPM_COMMENT_RE, ""))
    item = F.regexp_extract("line", R.PNPM_ITEM_RE, 1)
    opens, stops = F.col("line").rlike(R.PNPM_OPEN_RE), F.col("line").rlike(R.PNPM_END_RE)
    state = F.when(opens, F.lit(1)).when((item == "") & stops, F.lit(0))
    # the lines of one small file of each repository
    within = F.last(state, ignorenulls=True).over(Window.partitionBy("repo_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("repo_id", "pos", item.alias("glob"), within.alias("inside"), opens.alias("opens")).filter("inside = 1 and glob <> '' and not opens").select("repo_id", "pos", "glob")


def npm_globs(raw: DataFrame) -> DataFrame:
    """``repo_id, pos, glob``; a row with null glob stands for a field that lists nothing."""
    rows = npm_workspace_field(raw)
    listed = F.coalesce(F.from_json(F.to_json(F.when(F.col("kind").startswith("ARRAY"), F.col("ws"))), "array<string>"), F.from_json(F.to_json(F.try_variant_get("ws", "$.packages", "variant")), "array<string>"))
    return rows.select("repo_id", F.posexplode_outer(listed).alias("pos", "glob"))


def _workspaces(content: Column) -> Column:
    """The field that lists workspaces, if it is there and says anything."""
    field = F.try_variant_get(json_value(content), "$.workspaces", "variant")
    return let(field, lambda ws: F.when(ws.isNotNull() & (F.schema_of_variant(ws) != "VOID") & ~F.to_json(ws).isin("false", "0", '""'), ws))


def npm_workspace_field(raw: DataFrame) -> DataFrame:
    rows = raw.filter(F.col("relative_path") == "package.json").select("repo_id", _workspaces(F.col("content")).alias("ws"))
    return rows.filter("ws is not null").withColumn("kind", F.schema_of_variant("ws"))


def _root_findings(raw: DataFrame) -> DataFrame:
    """What manifests at the top say of the layout, read past ignore rules, in one pass: ``repo_id, ord, value, evidence``."""
    has = lambda name, test: (F.col("relative_path") == name) & test(F.col("text"))
    told = (
        ("npm/yarn workspaces", "package.json contains workspaces field", (F.col("relative_path") == "package.json") & _workspaces(F.col("content")).isNotNull()),
        ("Cargo workspace", "Cargo.toml contains [workspace]", has("Cargo.toml", lambda t: t.contains("[workspace]"))),
        ("Elixir umbrella", "mix.exs contains apps_path (umbrella project)", has("mix.exs", lambda t: t.contains("apps_path"))),
        ("SBT multi-project", "build.sbt contains multi-project definitions", has("build.sbt", lambda t: t.rlike(R.SBT_PROJECT_RE) | t.contains(".aggregate("))),
        ("Gradle multi-project", "settings.gradle contains include directives", has("settings.gradle", lambda t: F.size(_gradle_quoted(t)) > 0)),
        ("Gradle multi-project (Kotlin DSL)", "settings.gradle.kts contains include directives", has("settings.gradle.kts", lambda t: F.size(_gradle_quoted(t)) > 0)),
        ("Maven multi-module", "pom.xml contains <modules>", has("pom.xml", lambda t: t.contains("<modules>") & t.rlike(R.MAVEN_MODULE_RE))),
        ("uv workspace", "pyproject.toml contains [tool.uv.workspace]", has("pyproject.toml", lambda t: t.contains("[tool.uv.workspace]"))),
    )
    names = ("package.json", "Cargo.toml", "mix.exs", "build.sbt", "settings.gradle", "settings.gradle.kts", "pom.xml", "pyproject.toml")
    rows = raw.filter(F.col("relative_path").isin(*names)).withColumn("text", readable(F.col("content")))
    hits = (F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit((3 + i) * 10_000).cast("bigint").alias("ord"), F.lit(v).alias("value"), F.lit(e).alias("evidence"))) for i, (v, e, test) in enumerate(told))
    return rows.select("repo_id", F.inline(F.array_compact(F.array(*hits)))).distinct()


def _literal_hints(globs: DataFrame, files: DataFrame) -> DataFrame:
    """Hints of globs without wildcards, which name the folder of a manifest; ``globs`` of all stages at once."""
    literal = globs.filter(~F.col("glob").contains("*")).withColumn("relative_path", F.concat("glob", F.lit("/package.json")))
    manifests = primary(files).filter(F.col("name") == "package.json").select("repo_id", "relative_path", "content")
    one = literal.join(manifests, ["repo_id", "relative_path"]).withColumn("json", json_value(F.col("content")))
    name = F.coalesce(text_of(F.col("json"), "$.name"), basename(F.col("glob")))
    return _hints(one, F.col("stage"), F.col("pos"), 0, F.col("glob"), name, description=text_of(F.col("json"), "$.description"), manifest_path=F.col("relative_path"), manifest_name=F.lit("package.json"))


def _wildcard_parents(globs: DataFrame) -> DataFrame:
    """The top folders below which globs with wildcards look for components."""
    parents = globs.filter(F.col("glob").contains("*")).select("repo_id", "stage", "pos", F.get(F.split("glob", "/"), F.lit(0)).alias("parent"))
    return parents.filter("parent not in ('', '*')")


def _discovered_hints(df: DataFrame, number: Column | int, rule: Column | int) -> DataFrame:
    return _hints(df, number, rule, 0, F.col("path"), F.col("name"), description=F.col("description"), manifest_path=F.col("manifest_path"), manifest_name=F.col("manifest_name"))


def go_work_uses(files: DataFrame, raw: DataFrame) -> DataFrame:
    """``repo_id, pos, path`` of the modules that the file at the top uses."""
    rows = root_texts(raw, "go.work").join(having(files, "go.work"), "repo_id", "left_semi")
    strip = lambda line: trim(F.regexp_replace(line, R.GO_COMMENT_RE, ""))
    listed = F.filter(F.transform(lines_of(F.regexp_extract("text", R.GO_USE_BLOCK_RE, 1)), strip), lambda x: x != "")
    single = F.filter(F.transform(lines_of(F.col("text")), lambda x: F.regexp_extract(strip(x), R.GO_USE_LINE_RE, 1)), lambda x: x != "")
    return rows.select("repo_id", F.posexplode(F.when(F.col("text").rlike(R.GO_USE_BLOCK_RE), listed).otherwise(single)).alias("pos", "line")).select("repo_id", "pos", F.regexp_replace("line", r"^\./", "").alias("path"))


def _go_work_hints(files: DataFrame, raw: DataFrame) -> DataFrame:
    uses = go_work_uses(files, raw).withColumn("relative_path", F.concat("path", F.lit("/go.mod")))
    modules = primary(files).filter(F.col("name") == "go.mod").select("repo_id", "relative_path", F.lit("go.mod").alias("manifest_name"))
    joined = uses.join(modules, ["repo_id", "relative_path"], "left")
    known = F.col("manifest_name").isNotNull()
    return _hints(joined, GO_WORK, F.col("pos"), 0, F.col("path"), basename(F.col("path")), manifest_path=F.when(known, F.col("relative_path")), manifest_name=F.col("manifest_name"))


def _gradle_quoted(text: Column) -> Column:
    lines = F.regexp_extract_all(text, F.lit(R.GRADLE_INCLUDE_RE), F.lit(1))
    return F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(R.GRADLE_MODULE_RE), F.lit(1))))


def gradle_modules(raw: DataFrame, settings: str) -> DataFrame:
    """``repo_id, pos, path`` of all quoted modules of include lines; an empty path for a bare ':'."""
    return root_texts(raw, settings).select("repo_id", F.posexplode(_gradle_quoted(F.col("text"))).alias("pos", "module")).select("repo_id", "pos", F.replace(F.regexp_replace("module", "^:", ""), F.lit(":"), F.lit("/")).alias("path"))


def maven_modules(raw: DataFrame) -> DataFrame:
    rows = root_texts(raw, "pom.xml").filter(F.col("text").contains("<modules>"))
    return rows.select("repo_id", F.posexplode(F.regexp_extract_all("text", F.lit(R.MAVEN_MODULE_RE), F.lit(1))).alias("pos", "module")).select("repo_id", "pos", trim(F.col("module")).alias("path"))


def uv_members(raw: DataFrame) -> DataFrame:
    """``repo_id, pos, parent`` of the members' first folders."""
    rows = root_texts(raw, "pyproject.toml").filter(F.col("text").contains("[tool.uv.workspace]"))
    members = F.regexp_extract("text", R.UV_MEMBERS_RE, 1)
    entries = F.regexp_extract_all(members, F.lit(R.QUOTED_RE), F.lit(1))
    return rows.select("repo_id", F.posexplode(entries).alias("pos", "glob")).select("repo_id", "pos", F.get(F.split("glob", "/"), F.lit(0)).alias("parent")).filter("parent not in ('', '*')")


def component_hints(files: DataFrame, raw: DataFrame) -> DataFrame:
    """Hints of all stages, a path's later hints dropped as the stages do: ``repo_id, stage, rule, sub, path, name, description, manifest_path, manifest_name, kind``.

    What comes first is told by (stage, rule, sub).
    """
    found = discovered(files)
    staged = lambda df, number: df.withColumn("stage", F.lit(number))
    globs = staged(pnpm_globs(files, raw), PNPM).unionByName(staged(npm_globs(raw), NPM)).filter("glob is not null and not startswith(glob, '!')")
    umbrella = root_texts(raw, "mix.exs").filter(F.col("text").contains("apps_path")).select("repo_id", F.lit(0).alias("pos"), F.lit("apps").alias("parent"))
    # the folders that any stage looks below meet the discovered components in one join
    parents = _wildcard_parents(globs).unionByName(staged(umbrella, ELIXIR)).unionByName(staged(uv_members(raw), UV))
    pubspecs = primary(files).filter((F.col("name") == "pubspec.yaml") & (F.size("segments") > 1)).join(having(files, "melos.yaml"), "repo_id", "left_semi")
    pubspecs = pubspecs.withColumns({"folder": dirname(F.col("relative_path")), "json": json_value(F.col("content"))})
    convention = F.array_position(F.array(*map(F.lit, R.CONVENTION_FOLDERS)), F.col("parent"))
    stages = [
        sln_projects(files),
        _literal_hints(globs, files),
        _discovered_hints(parents.join(found, ["repo_id", "parent"]), F.col("stage"), F.col("pos")),
        _go_work_hints(files, raw),
        *(
            _hints(gradle_modules(raw, settings).filter("path <> ''"), number, 0, F.col("pos"), F.col("path"), basename(F.col("path")))
            for number, settings in ((GRADLE, "settings.gradle"), (GRADLE_KTS, "settings.gradle.kts"))
        ),
        _hints(maven_modules(raw).filter("path <> ''"), MAVEN, 0, F.col("pos"), F.col("path"), basename(F.col("path"))),
        _hints(pubspecs, MELOS, 0, 0, F.col("folder"), F.coalesce(text_of(F.col("json"), "$.name"), basename(F.col("folder"))), description=text_of(F.col("json"), "$.description")),
        _discovered_hints(found.filter(F.col("parent").isin(*R.CONVENTION_FOLDERS)), CONVENTION, convention),
    ]
    union = stages[0]
    for s in stages[1:]:
        union = union.unionByName(s)
    rows = union.withColumn("kind", F.expr(_NO_TEXT))
    # one stage adds its hints whether or not the path is taken
    hint = F.struct("stage", "rule", "sub", "name", "description", "manifest_path", "manifest_name", "kind")
    grouped = rows.groupBy("repo_id", "path").agg(F.min(hint).alias("first"), F.collect_set(F.when(F.col("stage") == NPM, hint)).alias("more"))
    return grouped.select("repo_id", "path", F.inline(F.array_union(F.array("first"), "more")))


def monorepo_findings(files: DataFrame, raw: DataFrame) -> DataFrame:
    """``repo_id, ord, value, evidence``, the synthetic ``monorepo`` last."""

    def rows(df: DataFrame, number: int, value: Column, evidence: Column, rule: Column | int = 0) -> DataFrame:
        rank = rule if isinstance(rule, Column) else F.lit(rule)
        return df.select("repo_id", (F.lit(number).cast("bigint") * 10_000 + rank).alias("ord"), value.alias("value"), evidence.alias("evidence"))

    def once(df: DataFrame, number: int, value: str, evidence: str) -> DataFrame:
        return rows(df.select("repo_id").distinct(), number, F.lit(value), F.lit(evidence))

    markers = by_name(files, R.MONOREPO_MARKERS).select("repo_id", "rule", F.col("name").alias("key"), "value").distinct()
    solutions = by_extension(primary(files), R.MONOREPO_EXTENSIONS).groupBy("repo_id", "rule", "value").agg(F.min_by("name", "relative_path").alias("name"))
    named = [
        rows(markers, 1, F.col("value"), F.concat(F.lit("found "), "key"), F.col("rule")),
        rows(solutions, 2, F.col("value"), F.concat(F.lit("found "), "name"), F.col("rule")),
        _root_findings(raw),
    ]
    union = named[0]
    for n in named[1:]:
        union = union.unionByName(n)
    conventional = discovered(files).filter(F.col("parent").isin(*R.CONVENTION_FOLDERS)).groupBy("repo_id", "parent").count().filter("count > 1")
    flagged = union.select("repo_id").unionByName(conventional.select("repo_id")).distinct()
    return union.unionByName(once(flagged, 99, "monorepo", "detected monorepo structure"))


def monorepo_flags(files: DataFrame, raw: DataFrame) -> DataFrame:
    """``repo_id, monorepo, tool_name`` of repositories with any finding."""
    named = F.col("value") != "monorepo"
    return monorepo_findings(files, raw).groupBy("repo_id").agg(F.lit(True).alias("monorepo"), F.min(F.when(named, F.struct("ord", "value"))).alias("t")).select("repo_id", "monorepo", F.col("t.value").alias("tool_name"))


