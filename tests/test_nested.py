import json
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborlake.model import COMPONENT, ENTRY, RESULT, SCOPE
from arborlake.operators.nested import NotJson, Place, flat_table, json_triples, read_triples, shred, shred_records

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**15), 10**15) | st.text(alphabet=st.characters(exclude_categories=("Cs",))),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4),
    max_leaves=20,
)


def rebuild(triples):
    """The value that a list of triples describes."""
    made, root = {}, None
    for place, step, value, ordinal in triples:
        plain = value
        if isinstance(value, Place):
            plain = made[value] = [] if value.is_list else {}
        if place is None:
            root = plain
        elif place.is_list:
            assert step == ordinal == len(made[place])
            made[place].append(plain)
        else:
            made[place][step] = plain
    return root


@settings(max_examples=150, deadline=None)
@given(JSON, st.sampled_from([None, 1]))
def test_triples_describe_the_value(value, indent):
    assert rebuild(json_triples(json.dumps(value, indent=indent))) == value


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a":1,}', "{'a':1}", "nul", "[1 2]", '{"a" 1}', "01", "1.", "NaN", '"\n"', "[1]x", "[,]", '{"a":}', "﻿{}"])
def test_strict_reading_refuses(text):
    with pytest.raises(NotJson):
        list(json_triples(text))


@pytest.mark.parametrize("text,value", [("[1,]", [1]), ('{"a":1 , }', {"a": 1}), ("[,]", []), ('{"a":[1,],}', {"a": [1]}), ('["a,]"]', ["a,]"])])
def test_trailing_commas_are_passed_over(text, value):
    assert rebuild(read_triples(text)) == value


@pytest.mark.parametrize("text", ["[1,,]", "[,,]", "[,1]", "[1", "", "  ", '{"a":1,"b"', '{"a" :"\\x"}', '{,"a":1}', "[1]]", '{"a":1]', "truex", "[1.5.2]", '["a" "b"]'])
def test_other_faults_stay(text):
    assert read_triples(text) is None and shred(text, RESULT) == []


def test_values_as_they_are_written():
    text = '{"a\\u00e9": "x\\ny", "b": -1.50e+3, "c": 123456789012345678901, "d": [true, false, null, [], {}], "a": "\\"", "e":{"f":"\\\\"}}'
    assert rebuild(json_triples(text)) == {"aé": "x\ny", "b": "-1.50e+3", "c": "123456789012345678901", "d": [True, False, None, [], {}], "a": '"', "e": {"f": "\\"}}
    last = list(json_triples('{"a":[{"b":7}]}'))[-1]
    assert (*last[0].path(), last[1]) == ("a", 0, "b") and last[2] == 7


def test_a_string_that_holds_json_stands_for_it():
    inner = '{"a": [1]}'
    assert rebuild(read_triples(json.dumps(json.dumps(inner)))) == {"a": [1]}
    assert rebuild(read_triples(json.dumps("just text"))) == "just text"


def test_depth_is_no_limit():
    start = time.time()
    assert sum(1 for _ in json_triples("[" * 500_000 + "]" * 500_000)) == 500_000
    text = '{"rootPath":"/r","architecture":' + '{"components":[{"path":"p","scoped":{"languageStats":{"perLanguage":[{"language":"Go"}]}},"x":' * 1 + "[" * 100_000 + "]" * 100_000 + "}]}}"
    assert [r.shape.name for r in shred(text, RESULT)] == ["results", "components", "scopes", "entries"]
    deep = '{"rootPath":"/r","architecture":{"components":[' + '{"path":"p","components":[' * 20_000 + "]}" * 20_000 + "]}}"
    rows = shred(deep, RESULT)
    assert len(rows) == 20_001 and rows[-1].depth == 20_000 and rows[-1].top is rows[0]
    assert time.time() - start < 20


PAYLOAD = {
    "meta": {"attempt": 1},
    "data": {
        "scan": [
            {
                "root_path": "/r",
                "architecture": {
                    "components": {
                        "libs/a": {
                            "name": "a",
                            "scoped": json.dumps({"language_stats": {"total_files": 3, "per_language": {"Go": {"files": 1}, "C": None}}}),
                            "components": [{"path": "libs/a/b", "scoped": {"languageStats": {"perLanguage": [{"language": "Py", "lines": "7"}, {}]}}}, {"path": "libs/a/c"}],
                        }
                    }
                },
                "languageStats": {"totalLines": 9, "perLanguage": [{"language": "Top"}]},
            }
        ]
    },
}


def test_rows_name_their_parents(spark, rows):
    df = spark.createDataFrame([(1, json.dumps(PAYLOAD), "x"), (1, json.dumps(PAYLOAD), "x"), (2, None, "y"), (3, "<html>", "z"), (4, "", "z"), (5, json.dumps(PAYLOAD)[:-9], "z")], "id int, payload string, row_id string")
    nodes = shred_records(df, ["id"], "payload", RESULT)
    assert [r[1:] for r in rows(flat_table(nodes, ["id"], RESULT).select("id", "root_path", "total_lines"))] == [("/r", 9)]
    assert rows(flat_table(nodes, ["id"], COMPONENT).select("path", "name")) == [("libs/a", "a"), ("libs/a/b", None), ("libs/a/c", None)]
    scopes = flat_table(nodes, ["id"], SCOPE)
    assert sorted(r.total_files or 0 for r in scopes.collect()) == [0, 3]
    entries = flat_table(nodes, ["id"], ENTRY)
    assert sorted((r.language or "", r.lines or 0, r.parent_table) for r in entries.collect()) == [("", 0, "scopes"), ("C", 0, "scopes"), ("Go", 0, "scopes"), ("Py", 7, "scopes"), ("Top", 0, "results")]
    joined = entries.filter("parent_table = 'scopes'").join(scopes.select("id", scopes.row_id.alias("parent_id")), ["id", "parent_id"])
    assert joined.count() == 4


def test_empty_table_gives_no_rows(spark):
    df = spark.createDataFrame([], "id int, payload string")
    assert flat_table(shred_records(df, ["id"], "payload", RESULT), ["id"], ENTRY).count() == 0


def plain_entries(payload):
    """The rows of p3_found from a payload, by json.loads alone."""

    def load(text):
        for t in (text, re.sub(r",(?=\s*[\]}])", "", text)):
            try:
                return load(v) if isinstance(v := json.loads(t), str) else v
            except ValueError:
                pass

    def get(value, name):
        return next((v for k, v in value.items() if k.replace("_", "").lower() == name), None) if isinstance(value, dict) else None

    def listed(value, key):
        if isinstance(value, dict):
            return [(next((x for x in [get(v, key)] if x is not None), k), v) for k, v in value.items()]
        return [(get(v, key), v) for v in value or [] if isinstance(v, dict)]

    def components(value, root, above):
        for path, c in listed(value, "path"):
            scoped = get(c, "scoped")
            stats = get(load(scoped) if isinstance(scoped, str) else scoped, "languagestats")
            for language, _ in listed(get(load(stats) if isinstance(stats, str) else stats, "perlanguage"), "language"):
                yield root, above, path, language
            yield from components(get(c, "components"), root, path)

    def results(value):
        if isinstance(value, list):
            for v in value:
                yield from results(v)
        elif isinstance(value, dict):
            if any(get(value, k) is not None for k in ("rootpath", "scannedat", "inventory", "architecture", "languagestats")):
                yield from components(get(get(value, "architecture"), "components"), get(value, "rootpath"), "")
            else:
                for v in value.values():
                    yield from results(v)

    return results(load(payload)) if payload else ()


def test_found_query_agrees_with_json_loads(spark, sf_dir):
    from arborlake.nested_queries import p3_found

    want = {(r.raw_id, *row) for r in spark.read.parquet(f"{sf_dir}/raw_scans.parquet").collect() for row in plain_entries(r.payload)}
    assert {tuple(r) for r in p3_found(spark, sf_dir).collect()} == want and want


def test_long_and_odd_texts(spark):
    big = {"rootPath": "/r", "architecture": {"components": [{"path": f"p{i}", "description": "x" * 1000, "scoped": {"languageStats": {"perLanguage": [{"language": "é\ud800"}]}}} for i in range(3000)]}}
    df = spark.createDataFrame([(1, json.dumps(big))], "id int, payload string")
    assert flat_table(shred_records(df, ["id"], "payload", RESULT), ["id"], ENTRY).count() == 3000
    random.seed(1)
