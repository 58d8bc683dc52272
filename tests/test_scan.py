import json
import re

import pytest

from pyspark.sql import functions as F

from arborlake.api import scan, scan_table
from arborlake.operators import components as C
from arborlake.operators.components import classified, leaves_only, owner_of
from arborlake.operators.ignore import indexed_files
from arborlake.functions.paths import derive
from arborlake.plans import detectors as D
from arborlake.plans import monorepo as M
from arborlake.render import report_of, share_text, to_json, to_table
from arborlake.sources.lookup import ini_entries
from arborlake.sources.tree import read_tree


def table(spark, files, repo="r"):
    return derive(spark.createDataFrame([(repo, p, c) for p, c in files.items()] or [("r", "x", "")], "repo_id string, relative_path string, content string"))


def values(df, column="value"):
    return sorted({r[column] for r in df.collect()})


@pytest.mark.parametrize(
    "rules,kept",
    [
        ("mill/\n!mill/wheel/\n", {".scanignore", "river/a.rs", "mill/wheel/c.rs"}),
        ("*.rs\n", {".scanignore"}),
        ("/river\n", {".scanignore", "mill/wheel/c.rs", "mill/stone/d.rs"}),
        ("**/stone/\n", {".scanignore", "river/a.rs", "mill/wheel/c.rs"}),
        ("stone/\nwheel\n", {".scanignore", "river/a.rs"}),
        ("mill/wheel/c.rs\n?.md\n!c.rs\n", {".scanignore", "river/a.rs", "mill/stone/d.rs", "mill/wheel/c.rs"}),
        ("# nothing\n\n", {".scanignore", "river/a.rs", "mill/wheel/c.rs", "mill/stone/d.rs"}),
    ],
)
def test_ignore_rules(spark, rules, kept):
    files = {".scanignore": rules, "river/a.rs": "", "mill/wheel/c.rs": "", "mill/stone/d.rs": ""}
    assert set(values(indexed_files(table(spark, files)), "relative_path")) == kept


def test_python_manager_covers_requirements_below_it(spark):
    files = {"a/poetry.lock": "", "a/requirements.txt": "x", "a/b/requirements.txt": "x", "c/requirements.txt": "x"}
    assert [r.evidence for r in D.pm_pip(table(spark, files)).collect()] == ["manifest: c/requirements.txt"]


def test_module_line_is_no_dependency(spark):
    files = {"a/go.mod": "module github.com/gin-gonic/gin\n", "b/go.mod": "module x\nrequire github.com/gin-gonic/gin v1\n"}
    assert [r.file_path for r in D.framework_go(table(spark, files)).collect()] == ["b/go.mod"]


def test_texts_beyond_the_reading_limit_are_not_read(spark):
    from arborlake.plans.rules import MAX_TEXT_BYTES

    fill = lambda n: "django\n" + "#" * (n - 7)
    files = {"a/requirements.txt": fill(MAX_TEXT_BYTES), "b/requirements.txt": fill(MAX_TEXT_BYTES + 1), "c/package.json": '{"dependencies": {"react": "1"}}' + " " * MAX_TEXT_BYTES}
    assert values(D.frameworks(table(spark, files)), "file_path") == ["a/requirements.txt", "c/package.json"]


def test_a_stage_can_be_added(spark, monkeypatch):
    from pyspark.sql import functions as F

    from arborlake.operators.rulejoin import Stage, hit

    own = Stage("owners", "ownership", lambda: F.col("name") == "CODEOWNERS", lambda: F.array(hit(1, F.lit("owners"), 1.0, F.lit("seen"), F.col("relative_path"))))
    monkeypatch.setattr(D, "REGISTRY", dict(D.REGISTRY))
    D.register("ownership", [own])
    found = D.findings(table(spark, {"CODEOWNERS": "", "Makefile": ""}))
    assert {(r.detector, r.value) for r in found.collect()} == {("ownership", "owners"), ("buildSystem", "Make")}


def test_a_text_that_cannot_be_read_takes_nothing_from_others(spark):
    files = {"a/package.json": '{"packageManager": 7, "dependencies": [1], "engines": "x", "workspaces": 3}', "b/package.json": '{"packageManager": "pnpm@9"}', "package.json": "[", "c/yarn.lock": ""}
    assert values(D.package_managers(table(spark, files))) == ["Yarn", "pnpm"]
    assert D.findings(table(spark, files), ["framework", "runtime"]).count() == 0


def test_comments_before_a_carriage_return(spark):
    files = {".tool-versions": "ruby 3.2 # old\r\ngo 1.22 # new\nzig 0.11 # last"}
    assert sorted((r.language, r.version) for r in D.runtimes(table(spark, files)).collect()) == [("Go", "1.22"), ("Ruby", "3.2 # old"), ("zig", "0.11")]


def test_languages_by_falling_confidence(spark):
    files = {**{f"a{i}.py": "" for i in range(4)}, "b.ts": "", "x.go": "", "go.mod": ""}
    assert [r.language for r in D.language_findings(table(spark, files)).orderBy("position").collect()] == ["Go", "Python", "TypeScript"]


def test_a_report_runs_nothing_until_it_is_asked_for(spark):
    tracker = spark.sparkContext.statusTracker()
    files = table(spark, {"a/b/package.json": "{}", ".scanignore": "x"})
    spark.sparkContext.setJobGroup("building", "building a report")
    try:
        report = scan_table(files)
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setJobGroup("other", "other")
    assert report.count() == 1


def test_line_counts_and_shares(spark):
    files = {"a.ts": "a\nb", "b.ts": "a\n", "c.ts": "", "d.py": "x"}
    assert sorted((r.language, r.files, r.lines, r.percentage) for r in D.language_stats(table(spark, files)).collect()) == [("Python", 1, 1, 25.0), ("TypeScript", 3, 3, 75.0)]


def test_deepest_component_owns_a_file(spark):
    parts = spark.createDataFrame([("r", "apps/web"), ("r", "apps/web/ui"), ("r", "apps")], "repo_id string, path string")
    files = spark.createDataFrame([("r", "apps/web/ui/a"), ("r", "apps\\web\\b"), ("r", "apps/webx/c"), ("r", "z")], "repo_id string, file string")
    assert sorted((r.file, r.component) for r in owner_of(files, "file", parts).collect()) == [("apps/web/ui/a", "apps/web/ui"), ("apps/webx/c", "apps"), ("apps\\web\\b", "apps/web")]
    assert values(leaves_only(parts), "path") == ["apps/web/ui"]


def test_first_hint_with_a_kind_wins(spark):
    hints = spark.createDataFrame(
        [("r", 1, "core", None, None, None, None), ("r", 2, "core", "core", "d", "core/package.json", None), ("r", 3, "web", None, None, None, None), ("r", 4, "x\\y", "n", None, None, "infra"), ("r", 5, "odd", "odd", None, None, "wrong")],
        "repo_id string, ord bigint, path string, name string, description string, manifest_path string, kind string",
    )
    assert sorted((r.path, r.name, r.kind) for r in classified(hints).collect()) == [("core", "core", "package"), ("x/y", "n", "infra")]


def test_gradle_and_maven(spark):
    raw = table(spark, {"settings.gradle": "include ':orchard', ':hill:barn'", "pom.xml": "<modules><module>pond</module><module>quay</module></modules>"})
    assert values(M.gradle_modules(raw, "settings.gradle"), "path") == ["hill/barn", "orchard"]
    assert values(M.maven_modules(raw), "path") == ["pond", "quay"]
    assert values(M.monorepo_findings(raw, raw)) == ["Gradle multi-project", "Maven multi-module", "monorepo"]


def test_ini_texts(spark, rows):
    df = spark.createDataFrame([(1, "; c\nTop = 1\n[ Core ]\nKey=a=b\nkey = c\n# x\nnope\n=v\n")], "id int, text string")
    assert rows(ini_entries(df, ["id"], "text")) == [(1, "", "top", "1"), (1, "core", "key", "c")]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "package.json": json.dumps({"workspaces": ["apps/*"], "dependencies": {"react": "1"}}),
        "apps/web/package.json": json.dumps({"name": "web", "dependencies": {"next": "1"}}) + ",",
        "apps/web/a.ts": "a\nb",
        "apps/web/.nvmrc": "20\n",
        "apps/api/package.json": json.dumps({"name": "api", "description": "d"}),
        "apps/api/Dockerfile": "",
        ".github/workflows/ci.yml": "on: push",
        "node_modules/x/index.js": "1",
        ".hidden/x.py": "1",
        "apps/skip/x.py": "1",
        ".scanignore": "skip/\n",
    }
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "link.py").symlink_to(root / "apps/web/a.ts")
    return str(root)


def test_tree_lists_hidden_and_empty_files_but_no_links(spark, tree):
    assert set(values(read_tree(spark, tree), "relative_path")) == {
        "package.json", "apps/web/package.json", "apps/web/a.ts", "apps/web/.nvmrc", "apps/api/package.json", "apps/api/Dockerfile", ".github/workflows/ci.yml", "apps/skip/x.py", ".scanignore",
    }


def test_tree_reads_what_is_wanted(spark, tmp_path):
    from arborlake.plans.rules import MAX_TEXT_BYTES

    big = b"x\n" * (MAX_TEXT_BYTES // 2) + b"y"
    deep = tmp_path / "a" / "b" / "c" / "d"
    deep.mkdir(parents=True)
    for name, text in {"a.py": big, "requirements.txt": big, "package.json": b" " * MAX_TEXT_BYTES + b"{}", "go.mod": b"module x", "notes.md": b"n", "e.ts": b""}.items():
        (deep / name).write_bytes(text)
    for depth in (1, 2, 6):
        rows = {r.name: (r.lines, r.content and len(r.content)) for r in read_tree(spark, str(tmp_path), split_depth=depth).collect()}
        assert rows == {"a.py": (MAX_TEXT_BYTES // 2 + 1, None), "requirements.txt": (None, None), "package.json": (None, MAX_TEXT_BYTES + 2), "go.mod": (None, 8), "notes.md": (None, None), "e.ts": (0, None)}
    assert values(read_tree(spark, str(tmp_path), extensions=(".PY", ".ts")), "name") == ["a.py", "e.ts"]
    assert {r.name: r.content for r in read_tree(spark, str(tmp_path), texts="all", extensions=(".md",)).collect()} == {"notes.md": "n"}
    assert {r.lines for r in read_tree(spark, str(tmp_path), texts="none").collect()} == {None}
    languages = D.language_stats(D.compact(read_tree(spark, str(tmp_path)))).collect()
    assert {(r.language, r.lines) for r in languages} == {("Python", MAX_TEXT_BYTES // 2 + 1), ("TypeScript", 0)}


def test_whole_scan(spark, tree):
    report = report_of(scan(spark, tree).collect()[0])
    assert report["inventory"]["languages"] == ["TypeScript"]
    assert report["inventory"]["frameworks"] == ["React"]  # the broken package.json says nothing
    assert report["inventory"]["ciProviders"] == ["GitHub Actions"] and report["inventory"]["containerization"] == ["Docker"]
    assert report["inventory"]["runtimes"] == [{"language": "Node", "version": "20", "source": ".nvmrc"}]
    assert report["architecture"]["monorepo"] and report["architecture"]["toolName"] == "npm/yarn workspaces"
    parts = {c["path"]: c for c in report["architecture"]["components"]}
    assert set(parts) == {"apps/web", "apps/api"} and parts["apps/api"]["secondaryKinds"] == ["service"] and parts["apps/api"]["description"] == "d"
    assert parts["apps/web"]["scoped"]["languageStats"]["totalLines"] == 2
    assert json.loads(to_json(report)) == report
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", report["scannedAt"]) and report["rootPath"] == tree
    assert "Turbo" not in to_table(report) and "npm/yarn workspaces" in to_table(report)


@pytest.mark.parametrize("chosen,parts", [([], set()), (["runtime"], {"inventory"}), (["language"], {"inventory", "languageStats"})])
def test_selection_slices_the_report(spark, chosen, parts):
    files = spark.createDataFrame([("r", "a.ts", "x")], "repo_id string, relative_path string, content string")
    assert set(scan_table(files, chosen).columns) == {"repo_id", "scannedAt"} | parts


def test_unknown_detector_is_refused(spark):
    with pytest.raises(ValueError):
        scan_table(spark.createDataFrame([("r", "a", "")], "repo_id string, relative_path string, content string"), ["nope"])


def test_json_of_odd_values():
    assert to_json({"a": float("nan"), "b": [], "c": {}, "d": 2.0, "e": True}) == '{\n  "a": null,\n  "b": [],\n  "c": {},\n  "d": 2,\n  "e": true\n}'
    assert share_text(1, 0.04) == "< 0.1" and share_text(1, 5.0) == "  5.0"


REPORT = {
    "scannedAt": "2025-01-01T00:00:00.000Z",
    "rootPath": "/work/own",
    "inventory": {
        "languages": ["Go", "Rust"], "frameworks": [], "packageManagers": ["Cargo", "npm"], "ciProviders": ["GitHub Actions"], "buildSystems": [], "containerization": [],
        "runtimes": [{"language": "Go", "version": "1.22", "source": "go.mod"}, {"language": "Python", "version": "3.11", "source": ".python-version"}],
    },
    "architecture": {
        "monorepo": True, "toolName": "Nx",
        "components": [
            {"path": "apps/a", "name": "a", "kind": "app", "secondaryKinds": ["service"], "description": "first", "scoped": {"frameworks": ["A", "B", "C", "D", "E"]}},
            {"path": "libs/b", "name": "b", "kind": "package"},
        ],
    },
    "languageStats": {"totalFiles": 1001, "totalLines": 1234567, "perLanguage": [{"language": "Go", "files": 1000, "lines": 1234560, "percentage": 99.9}, {"language": "Rust", "files": 1, "lines": 7, "percentage": 0.0}]},
}


def test_table_of_a_report():
    plain = re.sub(r"\033\[\d+m", "", to_table(REPORT))
    assert plain == """arborlake — scanned /work/own

Languages
  1,001 files, 1,234,567 lines
    Go              99.9%  (1000 files, 1,234,560 lines)
    Rust           < 0.1%  (   1 files,        7 lines)

Frameworks
  (none)

Package managers
  Cargo, npm

Build systems
  (none)

CI providers
  GitHub Actions

Containerization
  (none)

Runtimes
  Go      1.22  (from go.mod)
  Python  3.11  (from .python-version)

Monorepo
  yes (Nx)

Components
  app      (+service) a — first apps/a  A, B, C +2 more
  package  b libs/b  (none)

"""


def test_colours_and_a_reader_that_went_away(monkeypatch):
    import io

    from arborlake.render import BOLD, CYAN, GREEN, RESET, YELLOW, colored, write

    class Terminal(io.StringIO):
        def isatty(self):
            return True

    monkeypatch.delenv("NO_COLOR", raising=False)
    assert colored(False, Terminal()) and not colored(True, Terminal()) and not colored(False, io.StringIO())
    monkeypatch.setenv("NO_COLOR", "1")
    assert not colored(False, Terminal())
    assert to_json({"k": "v", "n": 1.5, "t": None}, True) == f'{{\n  {CYAN}"k"{RESET}: {GREEN}"v"{RESET},\n  {CYAN}"n"{RESET}: {YELLOW}1.5{RESET},\n  {CYAN}"t"{RESET}: {BOLD}null{RESET}\n}}'

    class Gone(io.StringIO):
        def write(self, text):
            raise BrokenPipeError

    write("x", Gone())


def test_completion_goes_where_the_shell_looks(tmp_path, monkeypatch, capsys):
    from arborlake import cli

    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_DATA_HOME", raising=False)
    monkeypatch.setenv("HOMEBREW_PREFIX", str(tmp_path / "brew"))
    monkeypatch.setattr(cli.os, "access", lambda path, mode: str(path).startswith(str(tmp_path)))
    monkeypatch.setattr(cli, "_zsh_path", lambda: [str(tmp_path / "functions")])
    assert cli.completion_file("bash") == f"{tmp_path}/home/.local/share/bash-completion/completions/arborlake"
    assert cli.completion_file("zsh") == f"{tmp_path}/home/.zfunc/_arborlake"
    assert cli.completion_file("fish") == f"{tmp_path}/home/.config/fish/completions/arborlake.fish"
    for folder in ("brew/etc/bash_completion.d", "brew/share/zsh/site-functions"):
        (tmp_path / folder).mkdir(parents=True)
    assert cli.completion_file("bash") == f"{tmp_path}/brew/etc/bash_completion.d/arborlake" and cli.completion_file("zsh") == f"{tmp_path}/brew/share/zsh/site-functions/_arborlake"
    (tmp_path / "functions").mkdir()
    assert cli.main(["completion", "install", "zsh"]) == 0 and (tmp_path / "functions/_arborlake").read_text().startswith("#compdef")
    assert cli.main(["completion", "uninstall", "zsh"]) == 0 and not (tmp_path / "functions/_arborlake").exists()


def test_cli(tmp_path, capsys):
    from arborlake.cli import main

    assert main(["detectors", "--json"]) == 0 and len(json.loads(capsys.readouterr().out)) == 8
    assert main(["-p", str(tmp_path / "none")]) == 2
    assert main(["completion", "bash"]) == 0 and "complete -F" in capsys.readouterr().out
    for wrong in (["--nope"], ["--detectors", "x"], ["what"], ["completion", "tcsh"]):
        with pytest.raises(SystemExit) as e:
            main(wrong)
        assert e.value.code == 1


def test_streams_count_like_batches(spark, sf_dir, tmp_path, rows):
    from pyspark.sql import functions as F

    from arborlake.streaming import daily_language_lines, event_counts

    for name, f in (("events", event_counts), ("language_entries", daily_language_lines)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.parquet").write_bytes(open(f"{sf_dir}/{name}.parquet", "rb").read())
        batch = spark.read.parquet(str(tmp_path / name))
        stream = f(spark.readStream.schema(batch.schema).parquet(str(tmp_path / name)))
        run = stream.writeStream.outputMode("complete" if name == "events" else "append").format("memory").queryName(f"out_{name}").trigger(availableNow=True).start()
        run.awaitTermination()
        out, whole = set(map(tuple, spark.table(f"out_{name}").collect())), set(map(tuple, f(batch).collect()))
        if name == "language_entries":
            # the watermark closes all days but those of the last 30
            last = batch.select(F.max(F.col("scanned_at").cast("timestamp")).alias("m")).first().m
            closed = {r for r in whole if (last.date() - r[0]).days > 31}
            assert closed and closed <= out <= whole
        else:
            assert out == whole and out


def test_first_hint_of_a_very_wide_solution(spark):
    projects = [(f"p{i}", f"p{i}/p{i}.csproj") for i in range(10_001)] + [("zeta", "twice/a.csproj"), ("alpha", "twice/b.csproj")]
    text = "\n".join(f'Project("{{G}}") = "{n}", "{p}", "{{H}}"' for n, p in projects)
    files = table(spark, {"a.sln": text})
    hints = M.component_hints(files, files)
    assert [r.name for r in hints.filter("path = 'twice'").collect()] == ["zeta"] and hints.count() == 10_002
    assert hints.agg({"sub": "max"}).collect()[0][0] == 10_001
    named = C.classified(hints.withColumn("kind", F.lit("app"))).filter("path = 'twice'").collect()
    assert [r.name for r in named] == ["zeta"]
