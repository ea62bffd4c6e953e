import pytest

from trellisq.model import PlanError
from trellisq.operators import graph as G

MEMBER = "id long, relationship_id long, source_model_id int, role string, member_order int, endpoint_global_id string, entity_id long"


@pytest.fixture(scope="module")
def world(spark):
    """A owns B and C, B owns A (a ring), C is bounded by D; another model uses the same ids; one end is unresolved."""
    m = [
        (1, 1, 1, "RelatingObject", None, "a", 1), (2, 1, 1, "relatedobjects", 0, "b", 2), (3, 1, 1, "RelatedObjects", 1, "c", 3), (4, 1, 1, "RelatedObjects", 2, "?", None), (5, 1, 1, "RelatedObjects", 3, "a", 1),
        (6, 2, 1, "RelatingObject", None, "b", 2), (7, 2, 1, "RelatedObjects", 0, "a", 1),
        (8, 3, 1, "RelatingSpace", None, "c", 3), (9, 3, 1, "RelatedBuildingElement", None, "d", 4),
        (10, 4, 2, "RelatingObject", None, "a", 1), (11, 4, 2, "RelatedObjects", 0, "z", 9),
        (12, 5, 1, "RelatingThing", None, "a", 1), (13, 5, 1, "RelatedThings", 0, "d", 4),
    ]
    r = [(1, 1, "IfcRelAggregates"), (2, 1, "IfcRelAggregates"), (3, 1, "IfcRelSpaceBoundary"), (4, 2, "IfcRelAggregates"), (5, 1, "IfcRelUnknown")]
    e = [(i, "g", c) for i, c in ((1, "IfcWall"), (2, "IfcWall"), (3, "IfcSpace"), (4, "IfcDoor"), (9, "IfcSlab"))]
    return spark.createDataFrame(m, MEMBER), spark.createDataFrame(r, "id long, source_model_id int, ifc_class string"), spark.createDataFrame(e, "id long, global_id string, ifc_class string"), spark.createDataFrame([(1,)], "id long")


def pairs(hops):
    return {(r.depth, r.from_id, r.to_id, r.direction) for r in hops.collect()}


def test_walks(world):
    m, r, e, seeds = world
    one, warn = G.traverse(seeds, m, r, 1, 1)
    assert pairs(one) == {(1, 1, 2, "outgoing"), (1, 1, 3, "outgoing"), (1, 1, 2, "incoming")} and warn == []
    two, _ = G.traverse(seeds, m, r, 1, 2)
    assert pairs(one) <= pairs(two) and (2, 3, 4, "outgoing") in pairs(two)
    three, _ = G.traverse(seeds, m, r, 1, 3)
    assert pairs(two) <= pairs(three)
    assert {(x.id, x.depth) for x in G.reached(three, seeds).collect()} == {(2, 1), (3, 1), (4, 2)}
    assert G.traverse(seeds, m, r, 1, 0)[0].count() == 0
    assert pairs(G.traverse(seeds, m, r, 1, 1, direction="incoming")[0]) == {(1, 1, 2, "incoming")}
    only, warn = G.traverse(seeds, m, r, 1, 2, ("IfcRelSpaceBoundary", "IfcRelFoo"))
    assert only.count() == 0 and "IfcRelFoo" in warn[0]
    with pytest.raises(PlanError):
        G.traverse(seeds, m, r, 1, 4)
    with pytest.raises(PlanError):
        G.traverse(seeds, m, r, 1, 1, direction="sideways")


def test_ends_connections_topology(world):
    m, r, e, seeds = world
    hops, _ = G.traverse(seeds, m, r, 1, 2)
    assert {x.id for x in G.endpoints(hops, seeds, e, ("IfcDoor",)).collect()} == {4}
    c = {(x.src_id, x.dst_id) for x in G.connections(hops).collect()}
    assert c == {(1, 2), (1, 3), (2, 1), (3, 4)}
    nodes, edges = G.topology(hops, seeds, e)
    assert {(x.node, x.n_entities) for x in nodes.collect()} == {("SEED", 1), ("IfcWall|IfcRelAggregates|RelatingObject", 1), ("IfcSpace|IfcRelAggregates|RelatedObjects", 1), ("IfcDoor|IfcRelSpaceBoundary|RelatedBuildingElement", 1)}
    assert nodes.where("node_id = 'n0'").first().node == "SEED" and edges.count() == 4


@pytest.mark.parametrize("n,e,h,want", [(3, 1, 1, "table"), (4, 40, 1, "graph"), (24, 40, 2000, "graph"), (25, 1, 1, "table"), (4, 41, 1, "table"), (4, 1, 2001, "table")])
def test_display_bounds(n, e, h, want):
    assert G.presentable(n, e, h) == want


def test_members(world):
    m, r, e, _ = world
    assert [x.id for x in G.relationship_members(m, 1).collect()] == [3, 4, 5, 1, 2]
    found, lost = G.expand_relationships(r.where("id = 1"), m, e)
    assert [x.entity_id for x in found.collect()] == [1, 2, 3] and [x.id for x in lost.collect()] == [4]
