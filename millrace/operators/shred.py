"""Problem 2: nested records shredded into an adjacency table and related flat tables.

Every object, array and scalar of a cell is a node (rec_no, field, cell, node, parent, label, ordinal, kind, scalar, depth,
top, key, above: the number of steps from the root, the node and label at depth 1 above it or itself, the label of its
parent). Node numbers follow the order of the document, so a parent comes before its parts; cell is a hash of the
cell's text, which keeps rows of a repeated rec_no apart (equal rows give equal nodes, as often as they occur). A text that
is itself a JSON object or array counts as that object or array, at any depth. A cell is parsed once, to one row that holds
its nodes as an array by number: the join of a node with its parent is then a look-up in that array, without a shuffle, and
paths are built that way, from the scalar up to the root. Entity tables are joins of container nodes with the
scalars of their children, all of them in ``scalars`` and the usual ones as columns, and keep ``parent`` and ``rec_no``.

Null cells, and cells that are not valid JSON (NaN and infinities included), give no node; a JSON null is a node without
scalar. Empty containers are nodes without parts. Of a key that an object repeats the last value counts. A cell that is
one scalar has the empty path. Numbers keep their text. Broken surrogates become U+FFFD. Cells nested deeper than the JSON
parser goes (thousands of levels) count as invalid.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

NODE = "node int, parent int, label string, ordinal int, kind string, scalar string, depth int, top int, key string, above string"
CELLS = "rec_no bigint, field string, cell bigint, nodes array<struct<" + ", ".join(f"{name}: {kind}" for name, kind in (x.split() for x in NODE.split(", "))) + ">>"
_NAMES = [x.split()[0] for x in NODE.split(", ")]
_TYPES = [pa.int32() if x.endswith("int") else pa.string() for x in NODE.split(", ")]
MOST_NODES = 50_000  # in a batch of cells, unless one cell has more


class _Number(str):
    """A number by its text."""


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


def parse(text: str):
    """The value of a JSON text; ValueError where it is none."""
    try:
        return _DECODER.decode(text.strip(" \t\n\r"))
    except RecursionError:
        raise ValueError("nested beyond the parser's depth") from None


def unwrap(value):
    """A text that is a JSON object or array is that object or array."""
    while type(value) is str:
        head = value.lstrip(" \t\n\r")[:1]
        if head not in ("{", "["):
            break
        try:
            value = parse(value)
        except ValueError:
            break
    return value


def shred(value) -> Iterator[tuple]:
    """The nodes of a value and all its parts, in document order."""
    stack, node = [(value, None, None, None, 0, None, None, None)], 0
    while stack:
        value, parent, label, ordinal, depth, top, key, above = stack.pop()
        if depth == 1:
            top, key = node, label
        value = unwrap(value)
        if isinstance(value, dict):
            kind, scalar, parts = "object", None, [(v, node, k, i, depth + 1, top, key, label) for i, (k, v) in enumerate(value.items())]
        elif isinstance(value, list):
            kind, scalar, parts = "array", None, [(v, node, None, i, depth + 1, top, key, label) for i, v in enumerate(value)]
        elif isinstance(value, bool):
            kind, scalar, parts = "boolean", "true" if value else "false", ()
        else:
            kind, scalar, parts = ("null", None, ()) if value is None else ("number" if isinstance(value, _Number) else "text", str(value), ())
        yield node, parent, label, ordinal, kind, scalar, depth, top, key, above
        stack.extend(reversed(parts))
        node += 1


def _column(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # halves of surrogate pairs
        return pa.array([x and x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in values], kind)


def _shredder(batches):
    for batch in batches:
        rows: list[tuple] = []
        cols: list[list] = [[] for _ in _TYPES]
        for rec, field, cell, number in zip(*(batch.column(i).to_pylist() for i in range(4))):
            try:
                value = parse(cell)
            except ValueError:
                continue
            # a cell that is a text is looked into once more by shred()
            for col, x in zip(cols, zip(*shred(value))):
                col.extend(x)
            rows.append((rec, field, number, len(cols[0])))
            if len(cols[0]) >= MOST_NODES:
                yield _batch(rows, cols)
                rows, cols = [], [[] for _ in _TYPES]
        if rows:
            yield _batch(rows, cols)


def _batch(rows: list[tuple], cols: list[list]) -> pa.RecordBatch:
    rec, field, number, ends = zip(*rows)
    nodes = pa.StructArray.from_arrays([_column(c, t) for c, t in zip(cols, _TYPES)], _NAMES)
    lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), nodes)
    return pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(field, pa.string()), pa.array(number, pa.int64()), lists], ["rec_no", "field", "cell", "nodes"])


def shredded(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """One row per valid JSON cell of ``fields`` (column -> name reported), with its nodes by number."""
    cells = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), F.col(c).alias("cell")) for c, name in fields.items()))).alias("v")
    rows = df.select(F.col(id_col).cast("bigint").alias("rec_no"), cells).select("rec_no", "v.*").where("cell IS NOT NULL").withColumn("number", F.conv(F.substring(F.md5("cell"), 1, 15), 16, 10).cast("bigint"))
    return rows.mapInArrow(_shredder, CELLS)


def path_of(x: Column, nodes: Column) -> Column:
    """The labels and positions from the root down to a node, joined by "/": as many look-ups of a parent as it is deep."""
    step = lambda n: F.coalesce(n["label"], n["ordinal"].cast("string"))
    start = F.struct(x.alias("at"), F.array().cast("array<string>").alias("steps"))
    up = lambda acc, _: F.struct(F.get(nodes, acc["at"]["parent"]).alias("at"), F.concat(F.array(step(acc["at"])), acc["steps"]).alias("steps"))
    steps = F.when(x["depth"] > 0, F.sequence(F.lit(1), x["depth"])).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, up, lambda acc: F.array_join(acc["steps"], "/"))


def with_paths(cells: DataFrame, wanted=None) -> DataFrame:
    """The nodes of shredded cells as rows with their ``path``; only those that meet ``wanted``, if given."""
    some = F.filter("nodes", wanted) if wanted else F.col("nodes")
    rows = F.transform(some, lambda x: F.struct(*(x[n].alias(n) for n in _NAMES), path_of(x, F.col("nodes")).alias("path")))
    return cells.select("rec_no", "field", "cell", F.inline(rows))


def adjacency(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """The adjacency table of the JSON cells ``fields`` (column -> name reported), with paths."""
    return with_paths(shredded(df, id_col, fields))


def scalar_paths(cells: DataFrame) -> DataFrame:
    """One row per scalar that is not null: (rec_no, field, path)."""
    return with_paths(cells, lambda x: x["scalar"].isNotNull()).select("rec_no", "field", "path")


def entity(nodes: DataFrame, owners: DataFrame, labels: list[str]) -> DataFrame:
    """Container nodes ``owners`` joined with their scalar children: one column per label of ``labels``, and ``scalars``,
    an array (ordinal, label, kind, scalar) of all of them, whatever their label, items of arrays (without label) too.

    The pivot is a partial aggregate on (rec_no, field, cell, parent); owners without such children keep null columns.
    """
    parts = nodes.where("scalar IS NOT NULL AND parent IS NOT NULL").groupBy("rec_no", "field", "cell", F.col("parent").alias("node"))
    # a set, because equal rows give equal nodes
    every = F.array_sort(F.collect_set(F.struct("ordinal", "label", "kind", "scalar"))).alias("scalars")
    wide = parts.agg(*(F.max(F.when(F.col("label") == x, F.col("scalar"))).alias(x) for x in labels), every)
    return owners.join(wide, ["rec_no", "field", "cell", "node"], "left")


def constraint_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The three nested cells of constraint records as related flat tables.

    cells        one per record and non-empty cell: root node and kind
    categories   one per key of an object cell of added_constraint and added_constraint_from_llm whose value is a
                 container, empty ones too, or null; a key whose value is a scalar is a constraint itself
    constraints  one per constraint of added_constraint and added_constraint_from_llm: category, body, weight (its own, else that of
                 its category)
    rules        one per rule of rule_evaluate_dict
    parts        one per other container (terms, judges, checks, params, ...) with its scalars
    values       every scalar with its path
    Each keeps rec_no, field, cell, node and parent; ``scalars`` of categories, constraints, rules and parts has every
    scalar directly in the container. Every container is in one of the first five, so each parent is a node
    of some table.
    """
    # parsed once, whatever tables are read
    nodes = with_paths(cut(shredded(df, "rec_no", {c: c for c in ("added_constraint", "rule_evaluate_dict", "added_constraint_from_llm")})))
    cells = nodes.where("parent IS NULL").select("rec_no", "field", "cell", "node", "kind")
    roots = cells.groupBy("rec_no", "field", "cell").agg(F.first("kind").alias("root_kind"))
    listed = nodes.where("field <> 'rule_evaluate_dict'").join(roots, ["rec_no", "field", "cell"])
    grouped = listed.where(F.col("root_kind") == "object").where("depth = 1 AND scalar IS NULL").select("rec_no", "field", "cell", "node", "parent", "label", "ordinal", "kind", "path")
    categories = entity(nodes, grouped, ["weight"])
    # a constraint is an item under a category, the category's own scalar, or an object of a constraint list
    in_object = "depth = 2 AND label IS NULL OR depth = 1 AND scalar IS NOT NULL OR depth = 3 AND above = 'items'"
    item = F.expr(f"root_kind = 'object' AND ({in_object}) OR root_kind = 'array' AND depth = 1")
    owners = listed.where(item).select("rec_no", "field", "cell", "node", "parent", "ordinal", "path", "scalar", "key", "top")
    weights = nodes.where("depth = 2 AND label = 'weight' AND scalar IS NOT NULL").groupBy("rec_no", "field", "cell", "top").agg(F.max("scalar").alias("of_top"))
    wide = entity(nodes, owners, ["type", "constraint_type", "text", "description", "weight"]).join(weights, ["rec_no", "field", "cell", "top"], "left")
    body = F.coalesce("scalar", "text", "description").alias("body")
    constraints = wide.select("rec_no", "field", "cell", "node", "parent", "ordinal", F.coalesce("type", "constraint_type", "key").alias("category"), body, F.coalesce("weight", "of_top").alias("weight"), "scalars", "path")
    ruled = nodes.where("field = 'rule_evaluate_dict' AND depth = 1 AND kind <> 'null'").select("rec_no", "field", "cell", "node", "parent", "ordinal", F.col("label").alias("rule"), "kind", "scalar", "path")
    rules = entity(nodes, ruled, [])
    parts = entity(nodes, nodes.where("kind IN ('object', 'array') AND depth >= 2").select("rec_no", "field", "cell", "node", "parent", "label", "ordinal", "kind", "path"), ["word", "count", "model", "name", "ok", "tool", "round", "by", "weight", "min", "max"])
    values = nodes.where("scalar IS NOT NULL").select("rec_no", "field", "cell", "node", "parent", "label", "ordinal", "kind", "scalar", "path")
    return {"cells": cells, "categories": categories, "constraints": constraints, "rules": rules, "parts": parts, "values": values}
