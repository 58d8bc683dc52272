"""Rules over files as array expressions: what a file matches becomes rows in one pass.

A rule table is a literal within an expression, read from one JSON text so that
plans stay small; nothing is joined or broadcast.  A ``Stage`` says which files it looks at and gives the hits in one
file as an array; any number of stages are put into one array per file and
opened into rows together, so all detectors share one scan of the files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT = "struct<detector:string,stage:int,rule:int,sub:int,value:string,version:string,confidence:double,evidence:string,file_path:string,scope:string>"
_TEXT = "cast(null as string)"


def hit(
    number: int, value: Column, confidence: float, evidence: Column, file_path: Column | None = None, rule: Column | int = 0, sub: Column | int = 0, version: Column | None = None, scope: Column | None = None
) -> Column:
    """One finding of a stage.  ``scope`` names what is found once in a repository, whichever file shows it first."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.expr(_TEXT)
    return F.struct(
        none.alias("detector"), F.lit(number).alias("stage"), as_column(rule).cast("int").alias("rule"), as_column(sub).cast("int").alias("sub"), value.alias("value"),
        (none if version is None else version).alias("version"), F.lit(float(confidence)).alias("confidence"), evidence.alias("evidence"),
        (none if file_path is None else file_path).alias("file_path"), (none if scope is None else scope).alias("scope"),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_RULE = "struct<rule:int,key:string,value:string,pattern:string>"


def _rules(pairs: Sequence[tuple]) -> list[dict]:
    return [{"rule": i, "key": k, "value": more[-1], **({"pattern": more[0]} if len(more) > 1 else {})} for i, (k, *more) in enumerate(pairs)]


def rules_of(pairs: Sequence[tuple], key: Column) -> Column:
    """The rules of a key as an array of ``rule`` (its position in the table), ``key``, ``value`` and ``pattern``; null without any."""
    grouped: dict[str, list[dict]] = {}
    for r in _rules(pairs):
        grouped.setdefault(r["key"], []).append(r)
    return F.from_json(F.lit(json.dumps(grouped)), f"map<string,array<{_RULE}>>")[key]


def each_rule(pairs: Sequence[tuple], key: Column, make: Callable[[Column], Column]) -> Column:
    return F.transform(rules_of(pairs, key), make)


def each_token(tokens: Column, pairs: Sequence[tuple], make: Callable[[Column, Column, Column], Column]) -> Column:
    """Hits of all tokens that are a rule's key: ``make`` gets the rule, the token and its position."""
    return F.flatten(F.array_compact(F.transform(tokens, lambda token, at: F.transform(rules_of(pairs, token), lambda rule: make(rule, token, at)))))


def each_found(pairs: Sequence[tuple[str, str]], test: Callable[[Column], Column], make: Callable[[Column], Column]) -> Column:
    """Hits of the rules whose key passes a test; all rules are tried, in their order."""
    return F.transform(F.filter(F.from_json(F.lit(json.dumps(_rules(pairs))), f"array<{_RULE}>"), lambda r: test(r["key"])), make)


@dataclass(frozen=True)
class Stage:
    """A stage of a detector: ``wanted`` says which files it looks at, ``hits`` what is found in one of them."""

    name: str
    detector: str
    wanted: Callable[[], Column]
    hits: Callable[[], Column]

    @property
    def __name__(self) -> str:
        return self.name

    def __call__(self, files: DataFrame) -> DataFrame:
        """The hits of this stage alone."""
        return expand(files, [self])


#: Set by the detectors: adds the columns that stages read to the files they look at.
Prepare = Callable[[DataFrame], DataFrame]
_PREPARE: list[Prepare] = []


def prepared_by(prepare: Prepare) -> Prepare:
    _PREPARE[:] = [prepare]
    return prepare


def expand(files: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """The hits of all stages in one pass: ``repo_id``, ``at`` (the file) and the fields of a hit."""
    wanted = [s.wanted() for s in stages]
    either = wanted[0]
    for w in wanted[1:]:
        either = either | w
    rows = files.filter(either)
    for prepare in _PREPARE:
        rows = prepare(rows)
    named = lambda s: F.transform(s.hits(), lambda h: h.withField("detector", F.lit(s.detector)))
    arrays = [F.when(w, named(s)).cast(f"array<{HIT}>") for s, w in zip(stages, wanted)]
    return rows.select("repo_id", F.col("relative_path").alias("at"), F.inline(F.flatten(F.array_compact(F.array(*arrays)))))


def first_wins(hits: DataFrame) -> DataFrame:
    """Of the hits of a repository with the same detector, value, version and file (or scope) that of the earliest stage, rule and path.

    Result: ``repo_id``, ``detector``, ``stage``, ``rule``, ``sub``, ``value``, ``version``, ``confidence``, ``evidence``, ``file_path``;
    findings of one detector and repository are in order by stage, rule, sub, then file.
    """
    place = F.struct("stage", "rule", "at", "sub", "evidence", "confidence", "file_path")
    kept = hits.groupBy("repo_id", "detector", "value", "version", F.coalesce("scope", "file_path", F.lit("")).alias("_key")).agg(F.min(place).alias("p"))
    return kept.select("repo_id", "detector", "p.stage", "p.rule", "p.sub", "value", "version", "p.confidence", F.array("p.evidence").alias("evidence"), "p.file_path")


def by_name(files: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Files whose name is a rule's key, with ``rule`` and ``value``; a row for each rule."""
    return files.filter(F.col("name").isin(*(k for k, *_ in pairs))).select("*", F.inline(rules_of(pairs, F.col("name")))).drop("key", "pattern")


def by_extension(files: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return files.filter(F.col("ext").isin(*(k for k, *_ in pairs))).select("*", F.inline(rules_of(pairs, F.col("ext")))).drop("key", "pattern")
