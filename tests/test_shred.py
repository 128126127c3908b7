import json

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import shred


def paths(cell):
    try:
        value = shred.parse(cell)
    except ValueError:
        return None
    nodes = list(shred.shred(value))

    def path(node):
        _, parent, label, ordinal, *_ = nodes[node]
        if parent is None:
            return ()
        return (*path(parent), label if label is not None else str(ordinal))

    return sorted("/".join(path(i)) for i, n in enumerate(nodes) if n[5] is not None)


def test_cells():
    assert paths('{"a": [1, null, "x", {"b": ""}], "c": {}, "d": true}') == ["a/0", "a/2", "a/3/b", "d"]
    assert paths('{"a": "[1, {\\"b\\": 2}]", "c": "[no"}') == ["a/0", "a/1/b", "c"]
    assert paths('"{\\"a\\": 1}"') == ["a"]
    assert paths('"[]"') == []
    assert paths("5") == [""]
    assert paths("null") == []
    assert paths('{"": {"": 1}}') == ["/"]
    for bad in ("", " ", "{", "NaN", '{"a": Infinity}', "[1,]", "{'a': 1}"):
        assert paths(bad) is None


def brute(value, path=()):
    if isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            value = json.loads(value)
        except ValueError:
            pass
    if isinstance(value, dict):
        for k, v in value.items():
            yield from brute(v, (*path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute(v, (*path, str(i)))
    elif value is not None:
        yield "/".join(path)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(values)
def test_against_recursion(value):
    assert paths(json.dumps(value)) == sorted(brute(value))
    nested = json.dumps({"k": json.dumps([value])})
    assert paths(nested) == sorted(brute({"k": [value]}))


def test_tables_keep_links(spark):
    rows = [
        (1, '{"Tone": ["Be calm."], "Keyword": [{"text": "Use it", "terms": [{"word": "w", "count": 2}]}]}', '{"keyword": {"func_input": ["t", {"a": 1}]}, "end_with": null}', None),
        (2, '[{"constraint_type": "Style", "description": "Plain"}]', "{broken", '"{}"'),
        (3, None, "", "null"),
        (4, '{"a": "\\ud800"}', None, None),
        (1, '{"Tone": "Be calm."}', None, None),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "rec_no long, added_constraint string, rule_evaluate_dict string, added_constraint_from_llm string, node string, path string")
    t = shred.constraint_tables(df)
    assert sorted((r.rec_no, r.category, r.body) for r in t["constraints"].collect() if r.rec_no < 4) == [(1, "Keyword", "Use it"), (1, "Tone", "Be calm."), (1, "Tone", "Be calm."), (2, "Style", "Plain")]
    assert [(r.rec_no, r.rule) for r in t["rules"].collect()] == [(1, "keyword")]
    words = [(r.word, r["count"]) for r in t["parts"].collect() if r.word]
    assert words == [("w", "2")]
    nodes = shred.adjacency(df.where("rec_no = 2"), "rec_no", {"added_constraint": "f"}).collect()
    by = {n.node: n for n in nodes}
    for n in nodes:
        assert n.parent is None or by[n.parent].kind in ("object", "array") and n.path.startswith(by[n.parent].path)
    known = {(r.rec_no, r.field, r.cell, r.node) for name in ("cells", "categories", "constraints", "rules", "parts") for r in t[name].collect()}
    assert all((r.rec_no, r.field, r.cell, r.parent) in known for name in ("categories", "constraints", "rules", "parts", "values") for r in t[name].collect() if r.parent is not None)
    empty = df.limit(0)
    assert all(x.count() == 0 for x in shred.constraint_tables(empty).values())


def test_long_and_repeated_cells(spark):
    cell = json.dumps({"k": list(range(100_000))})
    df = spark.createDataFrame([(1, cell), (1, cell)], "rec_no long, c string")
    assert shred.scalar_paths(shred.shredded(df, "rec_no", {"c": "c"})).count() == 200_000


def record(spark, *rows):
    return spark.createDataFrame(rows, "rec_no long, added_constraint string, rule_evaluate_dict string, added_constraint_from_llm string")


def test_every_parent_is_a_row(spark, sf):
    made = record(
        spark,
        (-1, '{"Tone": ["Be calm."], "Topic": [], "Form": null, "Style": {"items": ["Plain", ["odd"]], "weight": 2}, "Mood": "Glad"}', '[1, {"a": [[]]}]', '[["x"], {"type": "T", "params": {"a": []}}]'),
        (-2, '"{\\"A\\": {}}"', '{"keyword": {"func_input": ["t", {"a": [{}]}]}, "end_with": null, "n": 1}', "[null, {}]"),
    )
    given = spark.read.parquet(f"{sf}/constraint_records.parquet").select(*made.columns)
    t = {k: [r.asDict() for r in v.collect()] for k, v in shred.constraint_tables(made.unionByName(given)).items()}
    key = lambda r, x: (r["rec_no"], r["field"], r["cell"], r[x])
    known = {key(r, "node") for k, rows in t.items() if k != "values" for r in rows}
    assert all(r.get("parent") is None or key(r, "parent") in known for rows in t.values() for r in rows)
    got = {r["label"]: (r["kind"], r["weight"]) for r in t["categories"] if r["rec_no"] == -1}
    assert got == {"Tone": ("array", None), "Topic": ("array", None), "Form": ("null", None), "Style": ("object", "2")}
    assert [r["label"] for r in t["categories"] if r["rec_no"] == -2] == ["A"]


def test_every_scalar_is_in_its_table(spark):
    df = record(
        spark,
        (1, '{"and/or": {"items": ["Be calm.", {"text": "Plain", "weight": 5, "by/who": "x"}], "weight": 0.5, "new": true}, "a/b/c": "Short", "Tone": ["p/q"]}', '{"word_length": {"func_input": [{"min": 1, "max": "9", "unit": "w"}, "t"], "since": 3}}', None),
        (1, '{"and/or": {"items": ["Be calm.", {"text": "Plain", "weight": 5, "by/who": "x"}], "weight": 0.5, "new": true}, "a/b/c": "Short", "Tone": ["p/q"]}', None, None),
        (2, '[{"type": "T", "description": "D", "weight": 1, "note": ""}]', None, None),
    )
    t = {k: [r.asDict() for r in v.dropDuplicates(["rec_no", "field", "cell", "node"]).collect()] for k, v in shred.constraint_tables(df).items()}
    got = sorted((r["category"], r["body"], r["weight"], r["path"]) for r in t["constraints"])
    assert got == [("T", "D", "1", "0"), ("Tone", "p/q", None, "Tone/0"), ("a/b/c", "Short", None, "a/b/c"), ("and/or", "Be calm.", "0.5", "and/or/items/0"), ("and/or", "Plain", "5", "and/or/items/1")]
    named = {(r["path"], r["min"], r["max"]) for r in t["parts"] if r["min"]}
    assert named == {("word_length/func_input/0", "1", "9")}
    held = {(r["rec_no"], r["field"], r["cell"], r["node"], x.ordinal, x.label, x.kind, x.scalar) for k in ("categories", "constraints", "rules", "parts") for r in t[k] for x in r["scalars"] or ()}
    tops = {(r["rec_no"], r["field"], r["cell"], r["node"]) for r in t["cells"]}
    want = {(r["rec_no"], r["field"], r["cell"], r["parent"], r["ordinal"], r["label"], r["kind"], r["scalar"]) for r in t["values"] if (r["rec_no"], r["field"], r["cell"], r["parent"]) not in tops}
    assert held == want and len(want) > 12
