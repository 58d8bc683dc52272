"""Ignore rules of ``.scanignore`` files, and the folders a scan never enters.

The rules of a repository are one sorted list that its files meet in a single
join by repository; a file's verdict, and that of each folder above it, is an
expression over that list: the last rule that matches decides.  Rules without
wildcards are compared as text; only the others are regular expressions.  A
folder that is ignored is pruned with all below it unless a negated rule may
take something below it back in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import ancestors, basename, lines_of, segments, trim
from arborlake.functions.paths import folder_segments
from arborlake.plans.rules import IGNORED_FOLDERS, KEPT_DOT_FOLDERS, MAX_DEPTH

IGNORE_FILE = ".scanignore"


def reachable(path: Column) -> Column:
    """Whether a scan gets to a file: no folder that is never entered, no unknown dot folder, not too deep."""
    folders = folder_segments(path)
    never = F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_FOLDERS)))
    hidden = F.exists(folders, lambda s: F.startswith(s, F.lit(".")) & ~s.isin(*KEPT_DOT_FOLDERS))
    return ~never & ~hidden & (F.size(folders) <= MAX_DEPTH)


def walkable(files: DataFrame) -> DataFrame:
    return files.filter(reachable(F.col("relative_path")))


def glob_regex(pattern: Column) -> Column:
    """The regular expression, without anchors, of a glob: ``**/`` and ``**`` cross folders, ``*`` and ``?`` don't, all else is literal."""
    escaped = F.regexp_replace(pattern, r"([.()+^$\{\}|\[\]\\])", r"\\$1")
    # stars are set aside first, so that what they turn into isn't read again
    marked = F.replace(F.replace(F.replace(escaped, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("\u0002")), F.lit("*"), F.lit("[^/]*"))
    return F.replace(F.replace(F.replace(marked, F.lit("?"), F.lit("[^/]")), F.lit("\u0001"), F.lit("(?:.+/)?")), F.lit("\u0002"), F.lit(".*"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """``repo_id, ord, pattern, negated, dir_only, anchored, regex`` of all ignore files; ``regex`` is null for rules without wildcards.

    Rules of a nested file hold below its folder only.  ``ord`` is the order in
    which they apply: outer folders first, then by folder and line.
    """
    texts = files.filter(basename(F.col("relative_path")) == IGNORE_FILE).select("repo_id", F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1).alias("dir"), "content")
    lines = texts.select("repo_id", "dir", F.posexplode(lines_of(F.coalesce("content", F.lit("")))).alias("line_no", "raw")).withColumn("line", trim(F.col("raw")))
    lines = lines.filter("line <> '' and not startswith(line, '#')")
    body = F.regexp_replace("line", "^!", "")
    bare = F.regexp_replace(body, "/$", "")
    rows = lines.select(
        "repo_id", "dir", "line_no", F.startswith("line", F.lit("!")).alias("negated"), F.endswith(body, F.lit("/")).alias("dir_only"),
        F.startswith(bare, F.lit("/")).alias("slash"), F.regexp_replace(bare, "^/", "").alias("own"),
    ).filter("own <> ''")
    fixed = F.col("slash") | F.col("own").contains("/")
    nested = F.col("dir") != ""
    pattern = F.when(~nested, F.col("own")).when(fixed, F.concat("dir", F.lit("/"), "own")).otherwise(F.concat("dir", F.lit("/**/"), "own"))
    anchored = nested | fixed
    # the lines of a repository's few ignore files
    order = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.when(nested, F.size(segments(F.col("dir")))).otherwise(0), "dir", "line_no"))
    out = rows.select("repo_id", order.alias("ord"), pattern.alias("pattern"), "negated", "dir_only", anchored.alias("anchored"))
    start = F.when(F.col("anchored"), "^").otherwise("(?:^|/)")
    return out.withColumn("regex", F.when(F.col("pattern").rlike(r"[*?]"), F.concat(start, glob_regex(F.col("pattern")), F.lit("$"))))


def rule_lists(rules: DataFrame) -> DataFrame:
    """One row per repository: its ``rules``, the last one first."""
    rule = F.struct((-F.col("ord")).alias("o"), "pattern", "negated", "dir_only", "anchored", "regex")
    return rules.groupBy("repo_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def _is(rule: Column, path: Column) -> Column:
    """Whether a rule names this very path, a folder or a file."""
    plain = F.when(rule["anchored"], path == rule["pattern"]).otherwise(basename(path) == rule["pattern"])
    return F.when(rule["regex"].isNull(), plain).otherwise(F.rlike(path, rule["regex"]))


def _holds(rule: Column, path: Column) -> Column:
    """Whether a rule holds for a file; rules for folders hold for what is below a folder of that literal text."""
    below = F.when(rule["anchored"], F.startswith(path, F.concat(rule["pattern"], F.lit("/")))).otherwise(F.contains(F.concat(F.lit("/"), path), F.concat(F.lit("/"), rule["pattern"], F.lit("/"))))
    return F.when(rule["dir_only"], below).otherwise(_is(rule, path))


def verdict(rules: Column, path: Column, folder: bool = False) -> Column:
    """Whether the last rule that matches ignores the path; null if none matches."""
    test = _is if folder else _holds
    return ~F.get(F.filter(rules, lambda r: test(r, path)), F.lit(0))["negated"]


def is_pruned(rules: Column, folder: Column) -> Column:
    """Whether a folder is ignored and no negated rule may take anything below it back."""
    may_return = lambda r: r["negated"] & (~r["anchored"] | F.startswith(r["pattern"], F.lit("**/")) | F.startswith(r["pattern"], F.concat(folder, F.lit("/"))))
    return F.coalesce(verdict(rules, folder, True), F.lit(False)) & ~F.exists(rules, may_return)


def verdicts(paths: DataFrame, rules: DataFrame, path: str, folder: bool = False) -> DataFrame:
    """``repo_id``, the path and ``ignored``: the verdict of the last rule that matches; only paths with a match."""
    met = paths.join(rule_lists(rules), "repo_id").select("repo_id", path, verdict(F.col("rules"), F.col(path), folder).alias("ignored"))
    return met.filter("ignored is not null")


def pruned_folders(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``repo_id, folder`` of all pruned folders."""
    folders = files.select("repo_id", F.explode(ancestors(F.col("relative_path"))).alias("folder")).distinct()
    return folders.join(rule_lists(rules), "repo_id").filter(is_pruned(F.col("rules"), F.col("folder"))).select("repo_id", "folder")


def with_listed(raw: DataFrame) -> DataFrame:
    """``raw`` with ``listed``: whether a scan lists the file, that is, reaches it, prunes no folder above it and doesn't ignore it.

    A file meets one row, the rules of its repository; a repository that holds
    a large part of all files is split by adaptive execution, as any large
    side of an outer join.
    """
    lists = rule_lists(ignore_rules(walkable(raw)))
    path, rules = F.col("relative_path"), F.col("rules")
    ignored = F.coalesce(verdict(rules, path), F.lit(False)) | F.exists(ancestors(path), lambda folder: is_pruned(rules, folder))
    listed = reachable(path) & (rules.isNull() | ~ignored)
    return raw.join(lists, "repo_id", "left").withColumn("listed", F.coalesce(listed, F.lit(False))).drop("rules")


def indexed_files(raw: DataFrame) -> DataFrame:
    """The files of ``raw`` that a scan lists."""
    return with_listed(raw).filter("listed").drop("listed")
