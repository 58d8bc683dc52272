"""A virtual tree of files over the rows of ``documents``, the same in Spark and in SQL.

Each document becomes a file of one of 20 repositories; folder and name follow
from its id, and manifests get one of four fixed texts, so that every rule has
rows that match and rows that don't.  Every other one of the first documents
of a repository becomes a file at its top (workspace manifests, ignore rules)
or a file that those refer to.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.paths import basename, derive
from arborlake.runtime import read

FOLDERS = (
    "docs", "apps/web", "apps/web/src", "apps/admin", "services/api", "packages/ui", "packages/ui/src", "packages/core", "libs/util/tests", "crates/engine",
    ".github/workflows", "node_modules/dep", "examples/demo", "infra/prod", "tools/gen", ".cache/tmp",
    "db/migrations", "/".join(["d"] * 50), "/".join(["e"] * 51),
)
NAMES = (
    "index.ts", "main.py", "package.json", "Dockerfile", "lib.rs", "main.go", "go.mod", "Cargo.toml", "pyproject.toml", "requirements.txt", "Makefile", "App.tsx",
    "util.js", "Gemfile", ".nvmrc", ".tool-versions", "pom.xml", "build.gradle", "yarn.lock", "poetry.lock", "turbo.json", "server.ts", "vite.config.ts", "README.md",
    "ci.yml", "composer.json", "mix.exs", "App.csproj", "build.sbt", "settings.gradle", "settings.gradle.kts", "go.work", "pnpm-workspace.yaml", "mise.toml", "All.sln",
    "pubspec.yaml", "melos.yaml", "next.config.js", "Pipfile.lock", "build.gradle.kts", ".gitlab-ci.yml", "index.html", ".scanignore", "vercel.json", "uv.lock",
    "Rakefile", "Jenkinsfile", "schema.gen.ts", "api.pb.go", "Form.Designer.cs", "setup.cfg",
)
#: Files at the top, each in most repositories.
ROOTS = (
    ".scanignore", "package.json", "pnpm-workspace.yaml", "go.work", "settings.gradle", "pom.xml", "Cargo.toml", "mix.exs", "build.sbt", "pyproject.toml", "melos.yaml", "settings.gradle.kts",
    "turbo.json", "All.sln", "README.md", ".nvmrc", "Dockerfile", ".gitlab-ci.yml", "setup.cfg",
)
#: Files that those at the top refer to.
PARTS = (
    "packages/core/package.json", "services/api/go.mod", "apps/web/package.json", "apps/admin/package.json", "libs/util/package.json", "packages/ui/pyproject.toml", "packages/core/src/index.ts",
    "apps/web/src/App.tsx", "services/api/Dockerfile", "crates/engine/Cargo.toml", "mobile/app/pubspec.yaml", "tools/gen/main.py", "examples/demo/index.ts", "services/api/main.go", "tools/log/a.js",
    "apps/admin/server.ts", "core/Core.java",
)
SPAN = len(FOLDERS) * len(NAMES)
REPOS = 20
#: Four texts of each manifest; at least one does not match what it looks like.
TEXTS = {
    "package.json": (
        '{"name": "web", "description": "front", "dependencies": {"react": "18", "next": "14"}, "engines": {"node": ">=18", "pnpm": "9"}, "packageManager": "pnpm@9.1.0"}',
        '{"name": "root", "workspaces": ["apps/*", "packages/core", "!packages/x"], "devDependencies": {"vue": "3"}, "packageManager": "yarn@4"}',
        '{"workspaces": {"packages": ["libs/*", "./packages/*"]}, "dependencies": {"express": "4", "react-dom": "18",}, "engines": {"bun": "1"},}',
        '{"dependencies": {"react-doma": "1"}, "packageManager": "cargo@1", broken',
    ),
    "go.mod": (
        "module github.com/gin-gonic/gin\n\ngo 1.21\n",
        "module example.org/a\n\ngo 1.22.1\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n\tgoogle.golang.org/grpc v1.60.0\n)\n",
        "module example.org/b\nrequire github.com/labstack/echo/v4 v4.11.0\n",
        "  module github.com/go-chi/chi\n go 1.5\n",
    ),
    "Cargo.toml": (
        '[package]\nname = "engine"\nrust-version = "1.74"\n[dependencies]\naxum = "0.7"\n',
        '[workspace]\nmembers = ["crates/*"]\n',
        '[dependencies]\nactix-web = "4"\ntonic = "0.10"\n',
        '[package]\nname = "x"\n',
    ),
    "pyproject.toml": (
        '[project]\nrequires-python = ">=3.11"\ndependencies = ["fastapi>=0.100", "pydantic"]\n[tool.poetry]\n',
        '[tool.uv.workspace]\nmembers = ["packages/*", "libs/util"]\n[tool.uv.sources]\n',
        '[project]\nname = "djangology"\n[tool.pipenv]\n',
        '[project]\nname = "plain"\ndependencies = ["django-extra", "numpy"]\n',
    ),
    "requirements.txt": ("django==4.2\ncelery\n", "scikit-learn>=1\ntorch\n", "# none\nflask_login\n", ""),
    "Gemfile": ("source 'x'\nruby '3.2.2'\ngem 'rails'\n", 'ruby "3.1"\ngem "sinatra"\n', "gem 'railsy'\n", "  ruby '2.7'\n"),
    ".nvmrc": ("20.1.0\n", " v18 \nmore\n", "\n18\n", ""),
    ".tool-versions": ("nodejs 20.1.0\npython 3.11 3.10 # two\n", "# none\nruby\n", "Golang   1.22\nzig 0.11\n", "erlang 26.0\n\nelixir 1.15\n"),
    "mise.toml": ('[tools]\nnode = "20"\ngo = "1.22"\n[env]\nX = "1"\n', '[env]\nnode = "1"\n', '[tools]\n  uv = "0.4"\n', ""),
    "pom.xml": (
        "<project><modules><module>core</module><module> web </module></modules></project>",
        "<dependency><groupId>org.springframework.boot</groupId></dependency>",
        "<project><groupId>org.hibernate</groupId></project>",
        "<project/>",
    ),
    "build.gradle": ("implementation 'io.micronaut:core'", "plugins { id 'org.springframework.boot' }", "apply plugin: 'java'", "// io.ktor"),
    "build.gradle.kts": ('implementation("io.ktor:ktor")', 'id("io.quarkus")', "plugins {}", ""),
    "settings.gradle": ("include ':module-a', ':libs:core'\n", 'rootProject.name = "x"\n', "include 'apps:web'\nincludeBuild 'tools'\n", ""),
    "settings.gradle.kts": ('include("core")\ninclude("api")\n', 'rootProject.name = "y"\n', 'include(":services:api")\n', ""),
    "go.work": ("go 1.22\n\nuse (\n\t./services/api // main\n\t./tools/gen\n)\n", "go 1.22\nuse ./crates/engine\n", "go 1.22\n", "use (\n)\n"),
    "pnpm-workspace.yaml": ("packages:\n  - 'apps/*'\n  - packages/core\n  - '!**/x'\n", "packages:\n  - \"libs/*\" # all\ncatalog:\n  - no/*\n", "# none\n", "packages: []\n"),
    "composer.json": ('{"require": {"laravel/framework": "^10", "php": "8"}}', '{"require": {"slim/slim": "4"}}', '{"require-dev": {"yiisoft/yii2": "2"}}', "{}"),
    "mix.exs": ("apps_path: \"apps\"", "{:phoenix_live_view, \"~> 0.20\"}", "{:absinthe, \"~> 1.7\"}", "defmodule X do"),
    "App.csproj": ('<Project Sdk="Microsoft.NET.Sdk.Web">', '<PackageReference Include="Microsoft.AspNetCore.SignalR"/>', "<Project/>", "Microsoft.Maui"),
    "build.sbt": ("lazy val core = project", '"com.typesafe.akka" %% "akka"', ".aggregate(core)", 'name := "x"'),
    "All.sln": (
        'Project("{A}") = "Api", "services\\api\\Api.csproj", "{B}"\nEndProject\nProject("{A}") = "Root", "Root.csproj", "{C}"\n',
        'Project("{A}") = "Web", "src\\Web\\Web.fsproj", "{B}"\n',
        'Project("{A}") = "Docs", "docs", "{B}"\n',
        "",
    ),
    "pubspec.yaml": ("name: app\n", '{"name": "mobile", "description": "phone"}', "", "name: other\n"),
    "setup.cfg": ("; own\n[Metadata]\nName = x\nname=y\n[tool]\nk = a=b\n", "top = 1\n[ A ]\nkey\n=v\n", "# none\n[empty]\n", ""),
    ".scanignore": ("# rules\ntools/\n!tools/gen/\n*.log\n", "examples/\n/README.md\n", "src/*.js\n**/admin\n", "*.t?\n!index.ts\n"),
}


def virtual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_id, relative_path, content, name, ext, segments, is_secondary``: the unfiltered tree."""
    docs = read(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", "text", F.expr(f"doc_id % {REPOS}").alias("r"), F.expr(f"doc_id div {REPOS}").alias("seq"))
    # lists and texts are read from one literal each, which keeps plans small
    pick = lambda items, at: F.get(F.split(F.lit("|".join(items)), r"\|"), at.cast("int"))
    r, seq, turn = F.col("r"), F.col("seq"), F.expr("seq div 4")
    extra = F.when(seq >= SPAN, F.concat(F.lit("p"), F.expr(f"seq div {SPAN}").cast("string")))
    folder, name = pick(FOLDERS, seq % len(FOLDERS)), pick(NAMES, (seq + r) % len(NAMES))
    plain = F.concat_ws("/", folder, extra, name)
    path = (
        F.when((seq % 4 == 0) & (turn < len(ROOTS)), pick(ROOTS, (turn + r) % len(ROOTS)))
        .when((seq % 4 == 2) & (turn < len(PARTS)), pick(PARTS, (turn + r) % len(PARTS)))
        .otherwise(F.when(plain.isin(*PARTS), F.concat_ws("/", folder, F.lit("more"), name)).otherwise(plain))
    )
    texts = F.from_json(F.lit(json.dumps({f"{n}#{k}": t for n, four in TEXTS.items() for k, t in enumerate(four)})), "map<string,string>")
    rows = docs.select("doc_id", "text", r, path.alias("relative_path")).withColumn("_name", basename(F.col("relative_path")))
    fixed = texts[F.concat("_name", F.lit("#"), F.expr("doc_id div 3 % 4").cast("string"))]
    content = F.when(F.col("_name").isin(*TEXTS), fixed).otherwise(F.col("text"))
    return derive(rows.select(F.concat(F.lit("repo"), F.col("r").cast("string")).alias("repo_id"), "relative_path", content.alias("content")))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def virtual_files_sql() -> str:
    """The same as CTEs ``vfiles`` of a DuckDB query: start one with ``with`` + this."""
    cases = " ".join(f"when name = {_quoted(n)} and k = {k} then {_quoted(t)}" for n, four in TEXTS.items() for k, t in enumerate(four))
    listed = lambda items: "[" + ", ".join(map(_quoted, items)) + "]"
    return f"""v0 as (select doc_id, text, doc_id % {REPOS} as r, doc_id // {REPOS} as seq, doc_id // 3 % 4 as k from documents where doc_id is not null),
v1 as (select *, ({listed(FOLDERS)})[seq % {len(FOLDERS)} + 1] as dir, ({listed(NAMES)})[(seq + r) % {len(NAMES)} + 1] as plain_name, seq // 4 as turn from v0),
v2 as (select *, concat_ws('/', dir, case when seq >= {SPAN} then 'p' || (seq // {SPAN}) end, plain_name) as plain from v1),
v3 as (select *, case when seq % 4 = 0 and turn < {len(ROOTS)} then ({listed(ROOTS)})[(turn + r) % {len(ROOTS)} + 1] when seq % 4 = 2 and turn < {len(PARTS)} then ({listed(PARTS)})[(turn + r) % {len(PARTS)} + 1]
 when list_contains({listed(PARTS)}, plain) then dir || '/more/' || plain_name else plain end as relative_path from v2),
v4 as (select *, string_split(relative_path, '/')[-1] as name from v3),
vfiles as (select 'repo' || r as repo_id, relative_path, name, case {cases} else text end as content, lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1)) as ext from v4)"""
