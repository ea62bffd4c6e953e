import json

from hypothesis import given, settings
from hypothesis import strategies as st

from trellisq.operators.shred import Inlining, _load, flat_table, schema_edges, schema_graph, shred, shred_table


def brute(value, path=""):
    """Paths of the objects that are direct elements of arrays."""
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return
        if isinstance(inner, (dict, list)):
            yield from brute(inner, path)
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from brute(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            at = f"{path}[{i}]"
            held = v
            if isinstance(v, str):
                try:
                    held = json.loads(v)
                except ValueError:
                    held = v
            if isinstance(held, dict):
                yield at
            yield from brute(v, at)


leaf = st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from(["", "x", " [1,{\"a\":[{}]}] ", "{\"b\":[null,{\"c\":1}]}", "[broken", "{}", "\"[{}]\"", "7"])
tree = st.recursive(leaf, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["a", "b", "a b", "c.d"]), x, max_size=3), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(tree)
def test_paths_against_brute_force(record):
    value = _load(json.dumps(record))
    edges = set()
    if isinstance(value, (dict, list)):
        schema_edges(value, edges)
    plan = Inlining(edges)
    for p in (plan, Inlining(set(), everything=True)):
        rows = shred(value, p, True)
        assert sorted(r[1] for r in rows if r[4] and r[5]) == sorted(brute(record))
        nodes = {r[1] for r in rows}
        assert all(r[2] in nodes or r[2] == "" or r[2] is None for r in rows)
        assert sorted(r[1] for r in shred(value, p, False) if r[4] and r[5]) == sorted(r[1] for r in rows if r[4] and r[5])


def test_shared_inlining(spark, entities):
    record = {"type": {"name": "T", "owner": {"name": "O"}}, "storey": {"name": "S", "owner": {"name": "P"}}, "materials": [{"name": "m", "layers": [{"name": "l", "position": 0}, None, {"name": "k"}]}], "node": {"node": {"leaf": 1}}}
    rows = entities([(1, "IfcWall", record), (2, "IfcWall", None), (3, "IfcWall", "{broken"), (4, "IfcWall", "[]"), (5, "IfcWall", "7"), (6, "IfcWall", json.dumps(json.dumps({"materials": [{"name": "z"}]})))])
    plan = schema_graph(rows)
    assert plan.own == {"owner", "materials", "layers", "node"}
    out = shred_table(rows, "ifc_entities")
    got = {(r.record_id, r.table_name, r.node_id): r for r in out.collect()}
    root = got[1, "$", ""]
    assert root.columns == {"type.name": "T", "storey.name": "S"}
    assert got[1, "owner", "type.owner"].columns == {"name": "O"} and got[1, "owner", "storey.owner"].parent_node_id == ""
    layer = got[1, "layers", "materials[0].layers[2]"]
    assert layer.parent_node_id == "materials[0]" and layer.ordinal == 2 and layer.columns == {"name": "k"}
    assert got[1, "node", "node.node"].parent_node_id == "node" and got[1, "node", "node.node"].columns == {"leaf": "1"}
    assert {k[0] for k in got} == {1, 6}
    flat = {(r.record_id, r.node_id): (r.name, r.position) for r in flat_table(out, "layers", {"name": "string", "position": "int"}).collect()}
    assert flat == {(1, "materials[0].layers[0]"): ("l", 0), (1, "materials[0].layers[2]"): ("k", None)}


def test_long_and_empty(spark, entities):
    rows = entities([(1, "IfcWall", {"a": [{"b": [{"i": j} for j in range(3)]} for _ in range(5000)]})])
    assert shred_table(rows, "t", columns=False).where("in_array and is_object").count() == 20000
    assert shred_table(rows.where("false"), "t").count() == 0


def test_keys_that_are_data(spark, entities):
    """Sets and fields named by data share one table each, with the name as a column."""
    rows = entities([(i, "IfcWall", {"property_sets": {f"set {i}": {f"field {i}": {"value": i, "type": "int"}, "plain": "x"}, "odd": [1]}, "measurements": {"Height": {"value": 2.5}}}) for i in range(50)])
    assert schema_graph(rows).own >= {"property_sets{}", "property_sets{}{}", "measurements{}"} and len(schema_graph(rows).own) == 3
    out = shred_table(rows, "ifc_entities")
    got = {(r.node_id, r.parent_node_id): r.columns for r in out.where("record_id = 7 and table_name = 'property_sets{}{}'").collect()}
    assert got == {("property_sets.set 7.field 7", "property_sets.set 7"): {"key": "field 7", "value": "7", "type": "int"}, ("property_sets.set 7.plain", "property_sets.set 7"): {"key": "plain", "value": "x"}}
    assert flat_table(out, "measurements{}", {"key": "string", "value": "double"}).where("record_id = 3").first().value == 2.5


def test_any_depth(spark, entities):
    deep = "[" * 6000 + '{"a": "\\u00e4\\n", "b": [1, -2.5e3, true, null, {}]}' + "]" * 6000
    value = _load(deep)
    for _ in range(6000):
        value = value[0]
    assert value == {"a": "ä\n", "b": [1, -2500.0, True, None, {}]}
    nested = '{"a":' * 5000 + "[{}]" + "}" * 5000
    rows = entities([(1, "IfcWall", nested), (2, "IfcWall", "[" * 5000)])
    assert [(r.record_id, r.json_path) for r in shred_table(rows, "t", columns=False).where("in_array and is_object").selectExpr("record_id", "length(node_id) as json_path").collect()] == [(1, 9999 + 3)]


@settings(max_examples=200, deadline=None)
@given(tree)
def test_reading_without_recursion(record):
    from trellisq.operators.shred import _deep

    text = json.dumps(record, indent=1)
    assert _deep(text) == record
    for cut in range(0, len(text) - 1, 7):
        try:
            want = json.loads(text[:cut])
        except ValueError:
            want = ValueError
        try:
            got = _deep(text[:cut])
        except ValueError:
            got = ValueError
        assert got == want
