"""The queries of the core in SQL, over the same rule tables and virtual files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from arborlake.plans import rules as R
from arborlake.sources.vfiles import virtual_files_sql


def q(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def _list(items: Iterable[str]) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def _in(items: Iterable[str]) -> str:
    return "(" + ", ".join(map(q, items)) + ")"


def _rules(pairs: Sequence[tuple[str, str]]) -> str:
    return "(values " + ", ".join(f"({i}, {q(k)}, {q(v)})" for i, (k, v) in enumerate(pairs)) + ") r(rule, key, value)"


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _trim(x: str) -> str:
    return f"trim({x}, {_BLANK})"


_FOLDER_OF = "case when contains(relative_path, '/') then regexp_extract(relative_path, '^(.*)/[^/]*$', 1) else '.' end"
_ANCESTORS = "list_transform(range(1, len(segs)), lambda i: array_to_string(segs[1:i], '/'))"
_LINES = "case when coalesce(length(content), 0) = 0 then 0 else length(content) - length(replace(content, chr(10), '')) + case when ends_with(content, chr(10)) then 0 else 1 end end"
_JSON = "case when json_valid(content) then content when json_valid(regexp_replace(content, ',(\\s*[}\\]])', '\\1', 'g')) then regexp_replace(content, ',(\\s*[}\\]])', '\\1', 'g') end"
_ESCAPED = "regexp_replace(pattern, '([.()+^${}|\\[\\]\\\\])', '\\\\\\1', 'g')"
_GLOB = f"replace(replace(replace(replace(replace(replace({_ESCAPED}, '**/', chr(1)), '**', chr(2)), '*', '[^/]*'), '?', '[^/]'), chr(1), '(?:.+/)?'), chr(2), '.*')"
_LITERAL = "regexp_replace(pattern, '([.()+^${}|\\[\\]\\\\*?])', '\\\\\\1', 'g')"


#: The stored files as the source of the same relations: one row per repository and path.
_STORED = """vfiles as (select repo_id, relative_path, any_value(name) as name, any_value(content) as content, any_value(lower(coalesce(ext, regexp_extract(name, '^.+(\\.[^.]*)$', 1)))) as ext
 from files where repo_id is not null and relative_path is not null group by repo_id, relative_path)"""


def _ctes(source: str, reach: str = "reach", listed: bool = False) -> str:
    """All relations over the files that ``source`` defines as ``vfiles``; those of ``reach`` (or all, with ``vs``) count, or those not ignored, with ``listed``."""
    first = _rules  # short name for the literal tables below
    kinds = " ".join(f"when regexp_matches(path, {q(p)}) then {q(k)}" for p, k in R.KIND_BY_PATH)
    low = "lower(coalesce(name, ''))"
    kind = f"case when kind in {_in(R.KINDS)} then kind {kinds} when regexp_matches({low}, 'server|api|gateway') then 'service' when regexp_matches({low}, 'web|frontend|dashboard') then 'app' when coalesce(manifest_path, '') <> '' then 'package' end"
    indicator = lambda number, names, pairs, prefix, text="content": (
        f"select repo_id, {number} as stage, list_position({_list(names)}, name) as rule, r.rule as sub, value, 0.95::double as confidence, {q(prefix)} || key || ' in ' || relative_path as evidence, relative_path as file_path, relative_path as place"
        f" from prim, {first(pairs)} where name in {_in(names)} and content <> '' and contains({text}, key)"
    )
    by_name = lambda number, pairs, prefix, confidence, path="relative_path": (
        f"select repo_id, {number} as stage, rule, 0 as sub, value, {confidence}::double as confidence, {q(prefix)} || relative_path as evidence, {path} as file_path, relative_path as place from prim join {first(pairs)} on name = key"
    )
    runtime = lambda number, name, language, pattern, source: (
        f"select repo_id, {number} as stage, 0 as rule, 0 as sub, {q(language)} as language, {_trim(f'regexp_extract(content, {q(pattern)}, 1)')} as version, {q(source)} as source, relative_path from prim where name = {q(name)} and content <> ''"
    )
    alias = lambda x: f"coalesce(map_from_entries([{', '.join(f'({q(k)}, {q(v)})' for k, v in R.TOOL_ALIASES)}])[lower({x})], {x})"
    root = lambda name: f"(select repo_id, content from vfiles where relative_path = {q(name)} and content <> '')"
    own = lambda member: f"nullif(case when json_type(j, '$.{member}') = 'VARCHAR' then json_extract_string(j, '$.{member}') end, '')"
    given = lambda member: f"case when json_type(j, '$.{member}') = 'VARCHAR' then json_extract_string(j, '$.{member}') end"
    hint = lambda number, rule, sub, path, name, description="null::varchar", mpath="null::varchar", mname="null::varchar": (
        f"select repo_id, {number} as stage, {rule} as rule, {sub} as sub, {path} as path, {name} as name, {description} as description, {mpath} as manifest_path, {mname} as manifest_name"
    )
    workspace = lambda number, globs: (
        hint(number, "pos", 0, "glb", f"coalesce({given('name')}, split_part(glb, '/', -1))", "case when json_type(j, '$.description') = 'VARCHAR' then json_extract_string(j, '$.description') end", "relative_path", "'package.json'")
        + f" from (select g.repo_id, pos, glb, p.relative_path, {_JSON} as j from {globs} g join prim p on p.repo_id = g.repo_id and p.relative_path = glb || '/package.json' where glb is not null and not starts_with(glb, '!') and not contains(glb, '*'))"
        + " union all "
        + hint(number, "pos", 0, "path", "name", "description", "manifest_path", "manifest_name")
        + f" from {globs} g join discovered d using (repo_id) where glb is not null and not starts_with(glb, '!') and contains(glb, '*') and d.parent = split_part(glb, '/', 1) and d.parent not in ('', '*')"
    )
    gradle = lambda settings: (
        f"select repo_id, (generate_subscripts(m, 1) - 1) as pos, replace(regexp_replace(unnest(m), '^:', ''), ':', '/') as path from (select repo_id, flatten(list_transform(regexp_extract_all(content, 'include\\s*\\(?([^)\\n]+)\\)?', 1),"
        f" lambda x: regexp_extract_all(x, '[''\"](:?[^''\"]+)[''\"]', 1))) as m from {root(settings)})"
    )
    mono = lambda number, value, evidence, source: f"select distinct repo_id, {number * 10_000}::bigint as ord, {q(value)} as value, {q(evidence)} as evidence from {source}"
    starts = lambda prefixes: "(" + " or ".join(f"starts_with(name, {q(p)})" for p in prefixes) + ")"
    return f"""with {source},
ve as (select *, string_split(relative_path, '/') as segs from vfiles),
vd as (select *, segs[1:len(segs) - 1] as dirs from ve),
vs as (select *, list_has_any(dirs, {_list(R.SECONDARY_FOLDERS)}) as is_secondary from vd),
reach as (select * from vs where not list_has_any(dirs, {_list(R.IGNORED_FOLDERS)}) and len(list_filter(dirs, lambda s: starts_with(s, '.') and not list_contains({_list(R.KEPT_DOT_FOLDERS)}, s))) = 0 and len(dirs) <= {R.MAX_DEPTH}),
reached as (select repo_id, relative_path, unnest({_ANCESTORS}) as folder from reach),
ign_lines as (select repo_id, case when contains(relative_path, '/') then regexp_extract(relative_path, '^(.*)/[^/]*$', 1) else '' end as dir, generate_subscripts(l, 1) - 1 as line_no, {_trim("unnest(l)")} as line from (select *, string_split(coalesce(content, ''), chr(10)) as l from reach where name = '.scanignore')),
ign_parsed as (select *, starts_with(line, '!') as negated, regexp_replace(line, '^!', '') as body from ign_lines where line <> '' and not starts_with(line, '#')),
ign_bare as (select *, ends_with(body, '/') as dir_only, regexp_replace(body, '/$', '') as bare from ign_parsed),
ign_own as (select *, regexp_replace(bare, '^/', '') as own, starts_with(bare, '/') or contains(regexp_replace(bare, '^/', ''), '/') as fixed from ign_bare),
ign_pattern as (select repo_id, row_number() over (partition by repo_id order by case when dir = '' then 0 else len(string_split(dir, '/')) end, dir, line_no) as ord, case when dir = '' then own when fixed then dir || '/' || own else dir || '/**/' || own end as pattern, negated, dir_only, dir <> '' or fixed as anchored from ign_own where own <> ''),
ign as (select *, case when anchored then '^' else '(?:^|/)' end || {_GLOB} || '$' as dir_regex, case when dir_only then case when anchored then '^' else '(?:^|/)' end || {_LITERAL} || '/' else case when anchored then '^' else '(?:^|/)' end || {_GLOB} || '$' end as file_regex from ign_pattern),
ign_files as (select f.repo_id, f.relative_path, max_by(not negated, ord) as ignored from reach f join ign r on r.repo_id = f.repo_id and regexp_matches(f.relative_path, r.file_regex) group by all),
ign_dirs as (select f.repo_id, f.folder, max_by(not negated, ord) as ignored from (select distinct repo_id, folder from reached) f join ign r on r.repo_id = f.repo_id and regexp_matches(f.folder, r.dir_regex) group by all),
pruned as (select repo_id, folder from ign_dirs d where ignored and not exists (select 1 from ign r where r.repo_id = d.repo_id and r.negated and (not r.anchored or starts_with(r.pattern, '**/') or starts_with(r.pattern, d.folder || '/')))),
indexed as (select repo_id, relative_path from reach f where not exists (select 1 from ign_files i where i.repo_id = f.repo_id and i.relative_path = f.relative_path and ignored) and not exists (select 1 from reached a join pruned p on p.repo_id = a.repo_id and p.folder = a.folder where a.repo_id = f.repo_id and a.relative_path = f.relative_path)),
vf as (select * from {reach} {"semi join indexed using (repo_id, relative_path)" if listed else ""}),
prim as (select * from vf where not is_secondary),
anc as (select repo_id, relative_path, name, unnest({_ANCESTORS}) as folder from vf),
langs as (select repo_id, relative_path, value as language, {_LINES} as lines from vf join {first(R.EXT_TO_LANGUAGE)} on ext = key),
lang_counts as (select repo_id, language, count(*) as files, sum(lines)::bigint as lines from langs group by all),
lang_stats as (select *, floor(files::double / total_files * 1000 + 0.5) / 10 as percentage from (select *, sum(files) over (partition by repo_id)::bigint as total_files, sum(lines) over (partition by repo_id)::bigint as total_lines from lang_counts)),
fw_config as ({by_name(1, R.CONFIG_FRAMEWORKS, "config file: ", 1.0)}),
pkg as (select *, {_JSON} as j from prim where name in ('package.json', 'composer.json')),
npm_keys as (select repo_id, relative_path, unnest(json_keys(j, '$.dependencies')) as token, generate_subscripts(json_keys(j, '$.dependencies'), 1) - 1 as pos from pkg where name = 'package.json' and json_type(j, '$.dependencies') = 'OBJECT'),
php_keys as (select repo_id, relative_path, unnest(json_keys(j, '$.require')) as token, generate_subscripts(json_keys(j, '$.require'), 1) - 1 as pos from pkg where name = 'composer.json' and json_type(j, '$.require') = 'OBJECT'),
fw_npm as (select repo_id, 2 as stage, 0 as rule, pos as sub, value, 0.95::double as confidence, 'npm dependency: ' || token || ' in ' || relative_path as evidence, relative_path as file_path, relative_path as place from npm_keys join {first(R.NPM_FRAMEWORKS)} on token = key),
fw_python as (select repo_id, 3 as stage, case when name = 'pyproject.toml' then 0 else 1 end as rule, rule as sub, value, 0.9::double as confidence, 'Python dep: ' || key || ' in ' || relative_path as evidence, relative_path as file_path, relative_path as place
 from prim, {first(R.PYTHON_FRAMEWORKS)} where name in ('pyproject.toml', 'requirements.txt') and regexp_matches(content, '(?m)(?:^|[^a-zA-Z0-9_-])' || key || '(?:[^a-zA-Z0-9_-]|$)')),
fw_go as ({indicator(4, ("go.mod",), R.GO_FRAMEWORKS, "Go dep: ", "array_to_string(list_filter(string_split(content, chr(10)), lambda l: not starts_with(ltrim(l, " + _BLANK + "), 'module ')), chr(10))")}),
fw_rust as ({indicator(5, ("Cargo.toml",), R.RUST_FRAMEWORKS, "Rust crate: ")}),
fw_gem as (select repo_id, 6 as stage, rule, 0 as sub, value, 1.0::double as confidence, 'Gemfile contains ' || key as evidence, relative_path as file_path, relative_path as place from prim, {first(R.RUBY_FRAMEWORKS)} where name = 'Gemfile' and (contains(content, '''' || key || '''') or contains(content, '"' || key || '"'))),
fw_elixir as ({indicator(7, ("mix.exs",), R.ELIXIR_FRAMEWORKS, "Elixir dep: ")}),
fw_dotnet as (select repo_id, 8 as stage, 0 as rule, rule as sub, value, 0.95::double as confidence, '.NET reference: ' || key || ' in ' || relative_path as evidence, relative_path as file_path, relative_path as place from prim, {first(R.DOTNET_FRAMEWORKS)} where ext = '.csproj' and contains(content, key)),
fw_jvm as ({indicator(9, ("build.gradle", "build.gradle.kts", "pom.xml"), R.JVM_FRAMEWORKS, "JVM dep: ")}),
fw_php as (select repo_id, 10 as stage, 0 as rule, pos as sub, value, 0.95::double as confidence, 'Composer dep: ' || token || ' in ' || relative_path as evidence, relative_path as file_path, relative_path as place from php_keys join {first(R.PHP_FRAMEWORKS)} on token = key),
fw_scala as ({indicator(11, ("build.sbt",), R.SCALA_FRAMEWORKS, "SBT dep: ")}),
fw_all as ({" union all ".join(f"select * from fw_{n}" for n in ("config", "npm", "python", "go", "rust", "gem", "elixir", "dotnet", "jvm", "php", "scala"))}),
frameworks as ({_first_wins("fw_all")}),
pm_lockfile as ({by_name(1, R.LOCKFILES, "lockfile: ", 1.0, "null::varchar")}),
pm_manifest as (select repo_id, 2 as stage, rule, 0 as sub, value, 0.7::double as confidence, 'manifest: ' || relative_path as evidence, null::varchar as file_path, relative_path as place from prim
 join (values {", ".join(f"({i}, {q(n)}, {q(p)}, {q(v)})" for i, (n, p, v) in enumerate(R.MANIFESTS))}) r(rule, key, pattern, value) on name = key where pattern is null or regexp_matches(content, pattern)),
pm_extension as (select repo_id, 3 as stage, rule, 0 as sub, value, 0.7::double as confidence, 'manifest: ' || min(relative_path) as evidence, null::varchar as file_path, min(relative_path) as place from prim join {first(R.MANIFEST_EXTENSIONS)} on ext = key group by repo_id, rule, value),
declared as (select repo_id, relative_path, json_extract_string(j, '$.packageManager') as declared from pkg where name = 'package.json' and json_type(j, '$.packageManager') = 'VARCHAR'),
pm_field as (select repo_id, 4 as stage, 0 as rule, 0 as sub, value, 0.7::double as confidence, 'manifest: ' || relative_path || ' packageManager=' || declared as evidence, null::varchar as file_path, relative_path as place from declared join {first(R.PACKAGE_MANAGER_FIELD)} on lower(split_part(declared, '@', 1)) = key),
signals as (select distinct repo_id, {_FOLDER_OF} as folder from prim where name in {_in(R.PYTHON_SIGNAL_FILES)} or name = 'pyproject.toml' and regexp_matches(content, {q(R.POETRY_RE + "|" + R.UV_RE + "|" + R.PIPENV_RE)})),
pm_pip as (select repo_id, 5 as stage, 0 as rule, 0 as sub, 'pip' as value, 0.7::double as confidence, 'manifest: ' || relative_path as evidence, null::varchar as file_path, relative_path as place from prim p where name = 'requirements.txt'
 and not exists (select 1 from signals s where s.repo_id = p.repo_id and (s.folder = '.' or starts_with(p.relative_path, s.folder || '/')))),
pm_all as ({" union all ".join(f"select * from pm_{n}" for n in ("lockfile", "manifest", "extension", "field", "pip"))}),
package_managers as ({_first_wins("pm_all")}),
ci_all as ({by_name(1, R.CI_FILES, "config file: ", 1.0)} union all
 select repo_id, 2, rule, 0, value, 1.0::double, 'config under: ' || key || '/', min(relative_path), min(relative_path) from anc join {first(R.CI_FOLDERS)} on folder = key group by repo_id, rule, key, value),
ci_providers as ({_first_wins("ci_all")}),
bs_all as ({by_name(1, R.BUILD_FILES, "build file: ", 1.0)}),
build_systems as ({_first_wins("bs_all")}),
ct_all as ({by_name(1, R.CONTAINER_FILES, "container file: ", 1.0)}),
containers as ({_first_wins("ct_all")}),
rt_single as (select repo_id, 1 as stage, rule, 0 as sub, value as language, {_trim("split_part(content, chr(10), 1)")} as version, name as source, relative_path from prim join {first(R.SINGLE_VERSION_FILES)} on name = key where content <> ''),
rt_go as ({runtime(2, "go.mod", "Go", R.GO_VERSION_RE, "go.mod")}),
rt_gemfile as ({runtime(3, "Gemfile", "Ruby", "(?m)^\\s*ruby\\s+['\"]([^'\"]+)['\"]", "Gemfile#ruby")}),
rt_engines as (select repo_id, 4 as stage, 0 as rule, r.rule as sub, r.value as language, {_trim("json_extract_string(j, '$.engines.' || key)")} as version, 'package.json#engines.' || key as source, relative_path from pkg, {first(R.ENGINES)} where name = 'package.json' and json_type(j, '$.engines.' || key) = 'VARCHAR'),
rt_pyproject as ({runtime(5, "pyproject.toml", "Python", '(?m)^\\s*requires-python\\s*=\\s*"([^"]+)"', "pyproject.toml#requires-python")}),
rt_cargo as ({runtime(6, "Cargo.toml", "Rust", '(?m)^\\s*rust-version\\s*=\\s*"([^"]+)"', "Cargo.toml#rust-version")}),
tool_lines as (select repo_id, relative_path, generate_subscripts(l, 1) - 1 as line_no, string_split_regex({_trim(f"regexp_replace(unnest(l), {q(R.TOOL_COMMENT_RE)}, '')")}, '\\s+') as parts from (select *, string_split(content, chr(10)) as l from prim where name = '.tool-versions' and content <> '')),
rt_tool_versions as (select repo_id, 7 as stage, 0 as rule, line_no as sub, {alias("parts[1]")} as language, {_trim("array_to_string(parts[2:], ' ')")} as version, '.tool-versions' as source, relative_path from tool_lines where len(parts) > 1),
mise as (select repo_id, relative_path, name, regexp_extract_all(b, '(?m)^\\s*([A-Za-z0-9_-]+)\\s*=\\s*"([^"]+)"', 1) as tools, regexp_extract_all(b, '(?m)^\\s*([A-Za-z0-9_-]+)\\s*=\\s*"([^"]+)"', 2) as versions
 from (select *, string_split_regex(substring(content, instr(content, '[tools]') + 7), '(?m)^\\[')[1] as b from prim where name in ('mise.toml', '.mise.toml') and contains(content, '[tools]'))),
rt_mise as (select repo_id, 8 as stage, case when name = 'mise.toml' then 0 else 1 end as rule, pos as sub, {alias("tool")} as language, {_trim("version")} as version, name || '#tools.' || tool as source, relative_path
 from (select repo_id, relative_path, name, unnest(tools) as tool, unnest(versions) as version, generate_subscripts(tools, 1) - 1 as pos from mise)),
rt_all as (select * from ({" union all ".join(f"select * from rt_{n}" for n in ("single", "go", "gemfile", "engines", "pyproject", "cargo", "tool_versions", "mise"))}) where version <> ''),
rt_facts as (select *, row_number() over (partition by repo_id, language, version, relative_path order by stage, rule, sub, source) as rn from rt_all),
runtimes as (select repo_id, language, version, source from (select *, row_number() over (partition by repo_id, language, version order by stage, rule, relative_path, sub, source) as n from rt_facts where rn = 1) where n = 1),
cand as (select repo_id, array_to_string(segs[1:len(segs) - 1], '/') as path, relative_path, name, content, case when list_contains({_list(R.COMPONENT_MANIFESTS)}, name) then list_position({_list(R.COMPONENT_MANIFESTS)}, name) else 100 + list_position({_list(R.COMPONENT_EXTENSIONS)}, ext) end as rank
 from prim where len(segs) >= 3 and (name in {_in(R.COMPONENT_MANIFESTS)} or ext in {_in(R.COMPONENT_EXTENSIONS)})),
best as (select * from (select *, row_number() over (partition by repo_id, path order by rank, relative_path) as rn from cand) where rn = 1),
leaf as (select *, case when name = 'package.json' then {_JSON} end as j from best b where not exists (select 1 from best o where o.repo_id = b.repo_id and starts_with(o.path, b.path || '/'))),
discovered as (select repo_id, split_part(path, '/', 1) as parent, path, coalesce({own("name")}, split_part(path, '/', -1)) as name, {own("description")} as description, relative_path as manifest_path, leaf.name as manifest_name from leaf),
sln as (select repo_id, relative_path, regexp_extract_all(content, 'Project\\("[^"]*"\\)\\s*=\\s*"([^"]+)"\\s*,\\s*"([^"]+\\.(?:csproj|fsproj|vbproj))"', 1) as names, regexp_extract_all(content, 'Project\\("[^"]*"\\)\\s*=\\s*"([^"]+)"\\s*,\\s*"([^"]+\\.(?:csproj|fsproj|vbproj))"', 2) as projects,
 dense_rank() over (partition by repo_id order by relative_path) as rank from prim where ext = '.sln' and content <> '' and regexp_matches(content, 'Project\\("[^"]*"\\)\\s*=\\s*"([^"]+)"\\s*,\\s*"([^"]+\\.(?:csproj|fsproj|vbproj))"')),
sln_rows as (select repo_id, rank, generate_subscripts(names, 1) - 1 as pos, unnest(names) as name, regexp_extract(replace(unnest(projects), '\\', '/'), '^(.*)/[^/]*$', 1) as path from sln),
pnpm_lines as (select repo_id, generate_subscripts(l, 1) - 1 as pos, regexp_replace(unnest(l), {q(R.PNPM_COMMENT_RE)}, '') as line from (select repo_id, string_split(content, chr(10)) as l from {root("pnpm-workspace.yaml")} where repo_id in (select repo_id from vf where name = 'pnpm-workspace.yaml'))),
pnpm_state as (select *, regexp_matches(line, '^\\s*packages\\s*:') as opens, regexp_extract(line, '^\\s*-\\s*[''"]?([^''"\\s]+)[''"]?\\s*$', 1) as glb from pnpm_lines),
pnpm_inside as (select *, last_value(case when opens then 1 when glb = '' and regexp_matches(line, '^\\S') then 0 end ignore nulls) over (partition by repo_id order by pos rows between unbounded preceding and current row) as inside from pnpm_state),
pnpm_globs as (select repo_id, pos, glb from pnpm_inside where inside = 1 and glb <> '' and not opens),
npm_field as (select repo_id, json_extract(j, '$.workspaces') as ws, json_type(j, '$.workspaces') as kind from (select repo_id, {_JSON} as j from vfiles where relative_path = 'package.json') where json_type(j, '$.workspaces') not in ('NULL') and json_extract(j, '$.workspaces')::varchar not in ('false', '0', '""')),
npm_lists as (select repo_id, case when kind = 'ARRAY' then from_json(ws, '["VARCHAR"]') else from_json(json_extract(ws, '$.packages'), '["VARCHAR"]') end as l from npm_field),
npm_globs as (select repo_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as glb from npm_lists),
go_uses as (select repo_id, generate_subscripts(l, 1) - 1 as pos, regexp_replace(unnest(l), '^\\./', '') as path from (select repo_id, list_filter(case when regexp_matches(content, 'use\\s*\\(([^)]*)\\)')
 then list_transform(string_split(regexp_extract(content, 'use\\s*\\(([^)]*)\\)', 1), chr(10)), lambda x: {_trim(f"regexp_replace(x, {q(R.GO_COMMENT_RE)}, '')")})
 else list_transform(string_split(content, chr(10)), lambda x: regexp_extract({_trim(f"regexp_replace(x, {q(R.GO_COMMENT_RE)}, '')")}, '^use\\s+(\\S+)$', 1)) end, lambda x: x <> '') as l from {root("go.work")} where repo_id in (select repo_id from vf where name = 'go.work'))),
gradle_g as ({gradle("settings.gradle")}),
gradle_k as ({gradle("settings.gradle.kts")}),
maven as (select repo_id, generate_subscripts(l, 1) - 1 as pos, {_trim("unnest(l)")} as path from (select repo_id, regexp_extract_all(content, '<module>([^<]+)</module>', 1) as l from {root("pom.xml")} where contains(content, '<modules>'))),
uv as (select * from (select repo_id, generate_subscripts(l, 1) - 1 as pos, split_part(unnest(l), '/', 1) as parent from (select repo_id, regexp_extract_all(regexp_extract(content, '(?s)\\[tool\\.uv\\.workspace\\][^\\[]*members\\s*=\\s*\\[([^\\]]*)\\]', 1), '["'']([^"'']+)["'']', 1) as l from {root("pyproject.toml")} where contains(content, '[tool.uv.workspace]'))) where parent not in ('', '*')),
melos as (select repo_id, {_FOLDER_OF} as folder, {_JSON} as j from prim where name = 'pubspec.yaml' and len(segs) > 1 and repo_id in (select repo_id from vf where name = 'melos.yaml')),
hints_all as (
 {hint(1, "rank", "pos", "path", "name")} from sln_rows where path <> '' union all {workspace(2, "pnpm_globs")} union all
 {hint(3, "pos", 0, "path", "split_part(path, '/', -1)", mpath="m.relative_path", mname="m.name")} from go_uses u left join (select repo_id, relative_path, name from prim where name = 'go.mod') m using (repo_id) where false union all
 {hint(3, "pos", 0, "u.path", "split_part(u.path, '/', -1)", mpath="(select min(relative_path) from prim p where p.repo_id = u.repo_id and p.relative_path = u.path || '/go.mod')", mname="(select min(name) from prim p where p.repo_id = u.repo_id and p.relative_path = u.path || '/go.mod')")} from go_uses u union all
 {workspace(4, "npm_globs")} union all
 {hint(5, 0, 0, "path", "name", "description", "manifest_path", "manifest_name")} from discovered where parent = 'apps' and repo_id in (select repo_id from {root("mix.exs")} where contains(content, 'apps_path')) union all
 {hint(6, 0, "pos", "path", "split_part(path, '/', -1)")} from gradle_g where path <> '' union all {hint(7, 0, "pos", "path", "split_part(path, '/', -1)")} from gradle_k where path <> '' union all
 {hint(8, 0, "pos", "path", "split_part(path, '/', -1)")} from maven where path <> '' union all
 {hint(9, "pos", 0, "path", "name", "description", "manifest_path", "manifest_name")} from uv join discovered using (repo_id, parent) union all
 {hint(10, 0, 0, "folder", f"coalesce({given('name')}, split_part(folder, '/', -1))", "case when json_type(j, '$.description') = 'VARCHAR' then json_extract_string(j, '$.description') end")} from melos union all
 {hint(11, f"list_position({_list(R.CONVENTION_FOLDERS)}, parent)", 0, "path", "name", "description", "manifest_path", "manifest_name")} from discovered where parent in {_in(R.CONVENTION_FOLDERS)}),
hints as (select distinct repo_id, stage::bigint as stage, rule::bigint as rule, sub::bigint as sub, path, name, description, manifest_path, manifest_name, null::varchar as kind
 from (select *, row_number() over (partition by repo_id, path order by stage, rule, sub, name nulls first, description nulls first, manifest_path nulls first) as rn from hints_all) where rn = 1 or stage = 4),
hint_kinds as (select repo_id, (stage, rule, sub) as ord, replace(path, '\\', '/') as path, name, description, {kind.replace("(path,", "(replace(path, chr(92), '/'),")} as kind from hints),
comps as (select repo_id, path, coalesce(name, split_part(path, '/', -1)) as name, kind, nullif(description, '') as description from (select *, row_number() over (partition by repo_id, path order by ord, name, kind, description nulls first) as rn from hint_kinds where kind is not null) where rn = 1),
signs as (select repo_id, folder as path, max((name in {_in(R.APP_FILES)} or {starts(R.APP_PREFIXES)})::int) as app, max((name in {_in(R.SERVICE_FILES)})::int) as service, max({starts(R.PACKAGE_PREFIXES)}::int) as package from anc group by all),
seconds as (select c.repo_id, c.path, c.kind, array_to_string(list_filter([case when app = 1 then 'app' end, case when package = 1 then 'package' end, case when service = 1 then 'service' end], lambda x: x is not null and x <> c.kind), ',') as secondary_kinds from comps c left join signs s on s.repo_id = c.repo_id and s.path = c.path),
owners as (select a.repo_id, a.relative_path, max_by(c.path, length(c.path)) as component from (select repo_id, relative_path, folder from anc union all select repo_id, relative_path, relative_path from vf) a join comps c on c.repo_id = a.repo_id and c.path = a.folder group by all),
comp_counts as (select o.repo_id, o.component as path, language, count(*) as files, sum(lines)::bigint as lines from langs l join owners o on o.repo_id = l.repo_id and o.relative_path = l.relative_path group by all),
comp_langs as (select *, floor(files::double / total_files * 1000 + 0.5) / 10 as percentage from (select *, sum(files) over (partition by repo_id, path)::bigint as total_files, sum(lines) over (partition by repo_id, path)::bigint as total_lines from comp_counts)),
comp_fws as (select distinct f.repo_id, component as path, value as framework from frameworks f join owners o on o.repo_id = f.repo_id and o.relative_path = f.file_path),
mono_named as (select distinct repo_id, (10000 + rule)::bigint as ord, value, 'found ' || key as evidence from vf join {first(R.MONOREPO_MARKERS)} on name = key union all
 select repo_id, (20000 + rule)::bigint, value, 'found ' || min_by(name, relative_path) from prim join {first(R.MONOREPO_EXTENSIONS)} on ext = key group by repo_id, rule, value union all
 {mono(3, "npm/yarn workspaces", "package.json contains workspaces field", "npm_field")} union all {mono(4, "Cargo workspace", "Cargo.toml contains [workspace]", root("Cargo.toml") + " where contains(content, '[workspace]')")} union all
 {mono(5, "Elixir umbrella", "mix.exs contains apps_path (umbrella project)", root("mix.exs") + " where contains(content, 'apps_path')")} union all
 {mono(6, "SBT multi-project", "build.sbt contains multi-project definitions", root("build.sbt") + " where regexp_matches(content, 'lazy\\s+val\\s+\\w+\\s*=\\s*\\(?project') or contains(content, '.aggregate(')")} union all
 {mono(7, "Gradle multi-project", "settings.gradle contains include directives", "gradle_g")} union all {mono(8, "Gradle multi-project (Kotlin DSL)", "settings.gradle.kts contains include directives", "gradle_k")} union all
 {mono(9, "Maven multi-module", "pom.xml contains <modules>", "maven")} union all {mono(10, "uv workspace", "pyproject.toml contains [tool.uv.workspace]", root("pyproject.toml") + " where contains(content, '[tool.uv.workspace]')")}),
mono_repos as (select repo_id from mono_named union select repo_id from discovered where parent in {_in(R.CONVENTION_FOLDERS)} group by repo_id, parent having count(*) > 1),
mono as (select * from mono_named union all select repo_id, 990000::bigint, 'monorepo', 'detected monorepo structure' from mono_repos)
"""


def _first_wins(table: str) -> str:
    return (
        f"select repo_id, stage::bigint as stage, rule::bigint as rule, sub::bigint as sub, value, confidence, evidence, file_path from (select *, row_number() over (partition by repo_id, value, coalesce(file_path, '') order by stage, rule, place, sub, evidence) as rn from {table}) where rn = 1"
    )


def _report(whole: bool = True) -> str:
    """The nested report of every repository, its parts as JSON; otherwise that of the runtime and language detectors alone."""
    by_name = lambda x: f"icu_sort_key({x}, 'en')"
    values = lambda table: f"coalesce((select list(distinct value order by value) from {table} x where x.repo_id = r.repo_id), [])"
    entries = lambda where: f"coalesce(list({{'language': language, 'files': files, 'lines': lines, 'percentage': percentage}} order by percentage desc, language) {where}, [])"
    stats = lambda table, on: (
        f"(select {{'totalFiles': coalesce(any_value(total_files), 0), 'totalLines': coalesce(any_value(total_lines), 0), 'perLanguage': {entries('')}}} from {table} x where {on})"
    )
    runtimes = f"coalesce((select list({{'language': language, 'version': version, 'source': source}} order by {by_name('language')}, {by_name('version')}, language, version) from runtimes x where x.repo_id = r.repo_id), [])"
    languages = "coalesce((select list(language order by language) from lang_stats x where x.repo_id = r.repo_id), [])"
    lists = {"languages": languages} | {k: values(t) for k, t in (("frameworks", "frameworks"), ("packageManagers", "package_managers"), ("ciProviders", "ci_providers"), ("buildSystems", "build_systems"), ("containerization", "containers"))}
    parts = (lists if whole else {"languages": languages}) | {"runtimes": runtimes}
    inventory = "{" + ", ".join(f"{q(k)}: {v}" for k, v in parts.items()) + "}"
    component = (
        "{'path': c.path, 'name': c.name, 'kind': c.kind, 'secondaryKinds': case when s.secondary_kinds <> '' then string_split(s.secondary_kinds, ',') end, 'description': c.description, 'scoped': {"
        f"'frameworks': coalesce((select list(framework order by framework) from comp_fws f where f.repo_id = c.repo_id and f.path = c.path), []), 'languageStats': {stats('comp_langs', 'x.repo_id = c.repo_id and x.path = c.path')}}}}}"
    )
    architecture = (
        "{'monorepo': exists (select 1 from mono m where m.repo_id = r.repo_id), 'toolName': (select min_by(value, ord) from mono m where m.repo_id = r.repo_id and value <> 'monorepo'),"
        f" 'components': coalesce((select list(component order by kind, {by_name('name')}, path) from parts p where p.repo_id = r.repo_id), [])}}"
    )
    head = f", parts as (select c.repo_id, c.kind, c.name, c.path, {component} as component from comps c join seconds s using (repo_id, path)), rs as (select distinct repo_id from vfiles) "
    shown = f", to_json({architecture})::varchar as architecture" if whole else ""
    return f"{head} select repo_id, to_json({inventory})::varchar as inventory{shown}, to_json({stats('lang_stats', 'x.repo_id = r.repo_id')})::varchar as language_stats from rs r"


def build() -> dict[str, str]:
    virtual, stored = virtual_files_sql(), _STORED
    prelude = _ctes(virtual)
    kinds = " ".join(f"when regexp_matches(path, {q(p)}) then {q(k)}" for p, k in R.KIND_BY_PATH)
    low = "lower(coalesce(name, ''))"
    kind = f"case when kind in {_in(R.KINDS)} then kind {kinds} when regexp_matches({low}, 'server|api|gateway') then 'service' when regexp_matches({low}, 'web|frontend|dashboard') then 'app' when coalesce(manifest_path, '') <> '' then 'package' end"
    stage = "repo_id, value, confidence, evidence, file_path"
    own: dict[str, str] = {
        "virtual_files": "select repo_id, relative_path, name, ext, content from vfiles",
        "derived_columns": "select repo_id, relative_path, name, ext, len(segs)::bigint as depth, is_secondary from vs",
        "pruned_files": "select repo_id, relative_path from vf",
        "line_counts": f"select repo_id, relative_path, ({_LINES})::bigint as lines from vf",
        "language_stats": "select repo_id, language, files, lines, percentage, total_files, total_lines from lang_stats",
        "language_confidence": f"""select *, row_number() over (partition by repo_id order by confidence desc, language) as position from (select repo_id, coalesce(c.language, m.language) as language, coalesce(files, 0) as files,
 case when files is null then case when len(k) > 1 then 1.0 else 0.8 end when k is not null then 1.0 when files >= 10 then 1.0 when files >= 3 then 0.8 else 0.5 end::double as confidence,
 array_to_string(list_concat(case when files is not null then [files || ' file(s) with matching extensions'] else [] end, coalesce(list_transform(k, lambda x, i: case when i = 1 and files is null then case when x[1] = '1' then 'manifest file: ' || x[3] else x[3] || ' files found' end when x[1] = '1' then 'confirmed by ' || x[3] else 'confirmed by ' || x[3] || ' files' end), [])), '; ') as evidence
 from lang_counts c full join (select repo_id, value as language, list(['' || kind, printf('%03d', rule), key] order by kind, rule) as k from (select distinct repo_id, 1 as kind, rule, key, value from prim join {_rules(R.MANIFEST_CONFIRMS)} on name = key union all select distinct repo_id, 2, rule, key, value from prim join {_rules(R.EXT_MANIFEST_CONFIRMS)} on ext = key) group by repo_id, value) m using (repo_id, language))""",
        **{f"framework_{n}": f"select {stage} from fw_{n}" for n in ("config", "npm", "python", "go", "rust", "gem", "elixir", "dotnet", "jvm", "php", "scala")},
        **{f"pm_{n}": f"select {stage} from pm_{n}" for n in ("lockfile", "manifest", "extension", "field", "pip")},
        **{n: f"select stage, rule, sub, {stage} from {n}" for n in ("frameworks", "package_managers", "ci_providers", "build_systems", "containers")},
        **{f"runtime_{n}": f"select repo_id, language, version, source, relative_path from rt_{n} where version <> ''" for n in ("single", "go", "gemfile", "engines", "pyproject", "cargo", "tool_versions", "mise")},
        "runtimes": "select * from runtimes",
        "python_signals": "select * from signals",
        "sln_projects": "select repo_id, path, name from sln_rows where path <> ''",
        "workspace_globs": "select repo_id, 'pnpm' as tool, pos::bigint as pos, glb as pattern from pnpm_globs union all select repo_id, 'npm', pos::bigint, glb from npm_globs where glb is not null",
        "go_work": "select repo_id, pos::bigint as pos, path from go_uses",
        "gradle_modules": "select repo_id, 'settings.gradle' as settings, pos::bigint as pos, path from gradle_g union all select repo_id, 'settings.gradle.kts', pos::bigint, path from gradle_k",
        "maven_modules": "select repo_id, pos::bigint as pos, path from maven",
        "uv_members": "select repo_id, pos::bigint as pos, parent from uv",
        "component_discovery": "select * from discovered",
        "leaf_components": "select repo_id, path from leaf",
        "component_hints_derived": "select repo_id, stage, rule, sub, path, name, description, manifest_path, manifest_name from hints",
        "components": "select * from comps",
        "secondary_kinds": "select repo_id, path, kind, secondary_kinds from seconds",
        "component_owner": "select * from owners",
        "component_languages": "select repo_id, path, language, files, lines, percentage, total_files, total_lines from comp_langs",
        "component_frameworks": "select * from comp_fws",
        "monorepo_findings": "select * from mono",
        "monorepo_flag": "select repo_id, true as monorepo, (min_by(value, ord) filter (value <> 'monorepo')) as tool_name from mono group by repo_id",
        "inventory_flat": "select repo_id, 'languages' as category, language as value from lang_stats union select repo_id, 'frameworks', value from frameworks union select repo_id, 'packageManagers', value from package_managers union select repo_id, 'ciProviders', value from ci_providers union select repo_id, 'buildSystems', value from build_systems union select repo_id, 'containerization', value from containers",
        "ignore_rules": "select repo_id, ord, pattern, negated, dir_only, anchored from ign",
        "ignore_verdicts": "select repo_id, relative_path, ignored from ign_files",
        "pruned_folders": "select * from pruned",
        "indexed_files": "select repo_id, relative_path from indexed",
        "files_matching": "select repo_id, relative_path from vf where ext = '.toml' or name = 'Dockerfile'",
        "ini_entries": f"""select repo_id, relative_path, section, key, max_by(value, line_no) as value from (select repo_id, relative_path, line_no, section,
 lower({_trim("substring(line, 1, instr(line, '=') - 1)")}) as key, {_trim("substring(line, instr(line, '=') + 1)")} as value, line from (
 select *, coalesce(last_value(case when regexp_matches(line, '^\\[([^\\]]+)\\]$') then lower({_trim("regexp_extract(line, '^\\[([^\\]]+)\\]$', 1)")}) end ignore nulls) over (partition by repo_id, relative_path order by line_no rows between unbounded preceding and current row), '') as section
 from (select repo_id, relative_path, generate_subscripts(l, 1) as line_no, {_trim("unnest(l)")} as line from (select *, string_split(content, chr(10)) as l from vf where name = 'setup.cfg')) where line <> '' and not regexp_matches(line, '^[#;]'))
 where not regexp_matches(line, '^\\[[^\\]]+\\]$') and instr(line, '=') > 1) group by all""",
        "find_files": "select repo_id, relative_path from vf where name in ('package.json', 'Dockerfile') or ext in ('.ts', '.toml')",
        "files_under": "select repo_id, relative_path from vf where starts_with(relative_path, 'apps/web/') or relative_path = 'apps/web'",
        "repos_with": "select distinct repo_id from vf where name in ('turbo.json') or ext in ('.sln')",
        "test_files": "select repo_id, relative_path, is_secondary or regexp_matches(name, '\\.test\\.|\\.spec\\.|^test_|(?:_test\\.(?:go|py|exs|rs))$') as is_test, regexp_matches(name, '\\.gen\\.|\\.generated\\.|\\.Designer\\.|(?:\\.pb\\.(?:go|ts)|\\.g\\.(?:cs|dart))$') or regexp_matches(relative_path, '/[Mm]igrations/') as is_generated from vf",
    }
    out = {k: prelude + v for k, v in own.items()}
    checkouts = _ctes(stored, "vs")
    alike = {"package_managers": "package_managers", "ci_providers": "ci_providers", "containers": "containers", "runtimes": "runtimes", "confidence": "language_confidence"}
    out |= {f"checkout_{k}": checkouts + own[v] for k, v in (alike | {"components": "components", "monorepos": "monorepo_flag", "inventory": "inventory_flat"}).items()}
    out |= {"scan_report": _ctes(virtual, listed=True) + _report(), "checkout_report": _ctes(stored, listed=True) + _report(), "scan_report_part": _ctes(virtual, listed=True) + _report(False)}
    one_file = "(select repo_id, relative_path, any_value(name) as name, any_value(ext) as ext, any_value(content) as content from files where repo_id is not null and relative_path is not null group by all)"
    out["detector_catalog"] = "select * from (values " + ", ".join(f"({i}, {q(a)}, {q(b)})" for i, (a, b) in enumerate(R.DETECTORS)) + ") t(ord, id, description)"
    out["checkout_languages"] = (
        f"with f as (select *, lower(coalesce(ext, regexp_extract(name, '^.+(\\.[^.]*)$', 1))) as e from {one_file}), l as (select repo_id, value as language, {_LINES} as n from f join {_rules(R.EXT_TO_LANGUAGE)} on e = key),"
        " c as (select repo_id, language, count(*) as files, sum(n)::bigint as lines from l group by all)"
        " select repo_id, language, files, lines, floor(files::double / total_files * 1000 + 0.5) / 10 as percentage, total_files, total_lines from (select *, sum(files) over (partition by repo_id)::bigint as total_files, sum(lines) over (partition by repo_id)::bigint as total_lines from c)"
    )
    out["checkout_build_systems"] = f"select distinct repo_id, value from {one_file} join {_rules(R.BUILD_FILES)} on name = key where not list_has_any(string_split(relative_path, '/')[:-2], {_list(R.SECONDARY_FOLDERS)})"
    out["stored_findings"] = (
        "with f as (select finding_id, any_value(repo_id) as repo_id, any_value(detector) as detector, any_value(ord) as ord, any_value(lower(trim(value, ' ' || chr(9)))) as value, any_value(confidence) as confidence, any_value(file_path) as file_path from findings where finding_id is not null group by finding_id)"
        " select repo_id, detector, value, file_path, ord, confidence from (select *, row_number() over (partition by repo_id, detector, value, coalesce(file_path, '') order by ord, finding_id) as rn from f) where rn = 1"
    )
    out["stored_inventory"] = "select repo_id, detector, array_to_string(list(distinct lower(trim(value, ' ' || chr(9))) order by lower(trim(value, ' ' || chr(9)))), '|') as values from findings where value is not null group by all"
    out["component_kinds"] = (
        "with h as (select hint_id, any_value(repo_id) as repo_id, any_value(ord) as ord, any_value(replace(path, chr(92), '/')) as path, any_value(name) as name, any_value(description) as description, any_value(manifest_path) as manifest_path, any_value(kind) as kind from component_hints where hint_id is not null group by hint_id),"
        f" k as (select repo_id, ord, path, coalesce(name, split_part(path, '/', -1)) as name, nullif(description, '') as description, {kind} as kind from h where path is not null)"
        " select repo_id, path, name, kind, description from (select *, row_number() over (partition by repo_id, path order by ord, name nulls first, kind, description nulls first) as rn from k where kind is not null) where rn = 1"
    )
    out["stored_component_frameworks"] = (
        "with s as (select scan_id, any_value(architecture) as a from scan_results where scan_id is not null group by scan_id), c as (select scan_id, unnest(a.components) as c from s)"
        " select scan_id, c.path as path, case when len(c.scoped.frameworks) is null or len(c.scoped.frameworks) = 0 then '(none)' when len(c.scoped.frameworks) <= 3 then coalesce(array_to_string(list_filter(c.scoped.frameworks, lambda x: x is not null), ', '), '') else array_to_string(list_filter(c.scoped.frameworks[1:3], lambda x: x is not null), ', ') || ' +' || (len(c.scoped.frameworks) - 3) || ' more' end as summary from c"
    )
    out["share_text"] = "with e as (select entry_id, any_value(files) as files, any_value(percentage) as percentage from language_entries where entry_id is not null group by entry_id) select entry_id, case when files > 0 and percentage < 0.1 then '< 0.1' else lpad(printf('%.1f', percentage), greatest(5, length(printf('%.1f', percentage)))::int, ' ') end as share from e where percentage is not null"
    return out
