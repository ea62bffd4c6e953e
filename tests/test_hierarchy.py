import collections
import random

import pytest

from trellisq.operators import hierarchy as H

MEMBER = "id long, relationship_id long, role string, entity_id long, child long, parent long, v long"


def tables(spark, links, rel_class="IfcRelAggregates", entities=None, rows=None):
    """Tables of links (owner, owned), one relationship each, or of the member rows given."""
    if rows is None:
        rows = [x for k, (p, c) in enumerate(links) for x in ((2 * k, k, "RelatingObject", p), (2 * k + 1, k, "relatedobjects", c))]
    ids = {r[3] for r in rows if r[3] is not None} if entities is None else entities
    members = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], MEMBER)
    rels = spark.createDataFrame([(k, rel_class, "x") for k in sorted({r[1] for r in rows if r[1] is not None})], "id long, ifc_class string, role string")
    ents = spark.createDataFrame([(i, "x") for i in sorted(ids)], "id long, entity_id string")
    return members, rels, ents


def closure(links):
    up = collections.defaultdict(set)
    for p, c in links:
        up[c].add(p)

    def above(v):
        seen, stack = set(), list(up[v])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += up[x]
        return seen

    return {v: above(v) for v in list(up)}


def brute(links):
    a = closure(links)
    loop = {v: min(u for u in a[v] if v in a.get(u, ())) for v in a if v in a[v]}
    return {(v, loop[u]) for v in a for u in a[v] | {v} if u in loop}


def random_links():
    """Many small graphs side by side: trees, shared children, rings, knots and tails."""
    rng, links, base = random.Random(4), [], 0
    for k in range(60):
        n = rng.randint(1, 14)
        kind = k % 4
        for i in range(1, n):
            links.append((base + rng.randrange(i), base + i))
        if kind == 1 and n > 2:
            links += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(2)]
        if kind == 2:
            links.append((base + n - 1, base))
        if kind == 3:
            links += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(4)]
        base += n
    links.append((base, base))
    ring = 40
    links += [(base + 1 + i, base + 1 + (i + 1) % ring) for i in range(ring)]
    links += [(base + 200 + i, base + 201 + i) for i in range(70)]
    # a ring under a ring, and a node under both
    b = base + 500
    links += [(b, b + 1), (b + 1, b), (b + 1, b + 2), (b + 2, b + 3), (b + 3, b + 2), (b + 3, b + 4), (b, b + 5), (b + 4, b + 5), (b + 5, b + 6)]
    return links


@pytest.fixture(scope="module")
def graph(spark):
    links = random_links()
    return links, H.hierarchy_links(*tables(spark, links))


def test_loops_against_brute_force(graph):
    links, found = graph
    got = [(r.entity_id, r.loop_id) for r in H.on_or_below_loops(found).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(links)


def test_tree_against_brute_force(graph):
    links, found = graph
    a = closure(links)
    rows = H.hierarchy(found).collect()
    assert {r.entity_id for r in rows} == {x for p in links for x in p}
    by = {r.entity_id: r for r in rows}
    real = set(links)
    for r in rows:
        assert r.path[-1] == r.entity_id and r.path[0] == r.root_id and r.depth == len(r.path) - 1 and len(set(r.path)) == len(r.path)
        assert set(r.path[:-1]) <= a.get(r.entity_id, set())
        if r.parent_id is not None and r.loop_id is None:
            assert (r.parent_id, r.entity_id) in real
        assert (r.loop_id is not None) == (r.entity_id in a.get(r.entity_id, ()))
    below = collections.Counter(x for r in rows for x in r.path[:-1])
    for r in rows:
        assert r.n_descendants == below[r.entity_id]
        inside = {x.entity_id for x in rows if x.root_id == r.root_id and r.entry < x.entry < r.exit}
        assert inside == {x.entity_id for x in rows if r.entity_id in x.path[:-1]}
    acyclic = {v for v in by if not any(u in a.get(u, ()) for u in a.get(v, set()) | {v})}
    single = collections.Counter(c for _, c in real)
    for v in acyclic:
        if all(single[u] <= 1 for u in a.get(v, set()) | {v}):
            assert by[v].depth == len(a.get(v, ()))


def test_what_does_not_count(spark):
    rows = [(1, 1, "RelatingObject", 10), (2, 1, "RelatedObjects", 11), (3, 1, "RelatedObjects", 11), (4, 1, None, 12), (5, 1, "RelatedObjects", None), (6, 1, "Other", 13), (7, None, "RelatedObjects", 14), (8, 1, "RELATEDOBJECTS", 15)]
    m, r, e = tables(spark, None, rows=rows, entities={10, 11, 12, 13, 14})
    assert {(x.child, x.parent) for x in H.hierarchy_links(m, r, e).collect()} == {(22, 20)}
    assert H.hierarchy_links(m, r.selectExpr("id", "'IfcRelSpaceBoundary' as ifc_class"), e).count() == 0


def test_several_owners_by_a_hub(spark):
    rows = [(1, 5, "RelatingObject", 1), (2, 5, "RelatingObject", 2), (3, 5, "RelatedObjects", 3), (4, 5, "RelatedObjects", 4), (5, 6, "RelatingObject", 4), (6, 6, "RelatedObjects", 2)]
    links = [(1, 3), (1, 4), (2, 3), (2, 4), (4, 2)]
    found = H.hierarchy_links(*tables(spark, None, rows=rows))
    assert {(r.entity_id, r.loop_id) for r in H.on_or_below_loops(found).collect()} == brute(links) == {(2, 2), (4, 2), (3, 2)}
    assert {r.entity_id for r in H.hierarchy(found).collect()} == {1, 2, 3, 4}


def test_empty(spark):
    m, r, e = tables(spark, [(1, 2)])
    none = H.hierarchy_links(m.where("false"), r, e)
    assert H.on_or_below_loops(none).count() == 0
    assert H.hierarchy(none).count() == 0
    assert H.descendants(H.hierarchy(H.hierarchy_links(m, r, e))).collect()[0].asDict() == {"entity_id": 1, "descendant_id": 2, "levels": 1}


def distances(links):
    """Fewest links from each node down to every other."""
    down = collections.defaultdict(set)
    for p, c in links:
        down[p].add(c)
    out = {}
    for v in {x for p in links for x in p}:
        far, edge = {v: 0}, [v]
        while edge:
            edge = [c for c in {c for x in edge for c in down[x]} if c not in far and far.setdefault(c, far[next(x for x in edge if c in down[x])] + 1)]
        out |= {(v, x): n for x, n in far.items() if x != v}
    return out


def test_all_descendants_against_closure(graph):
    links, found = graph
    got = [(r.entity_id, r.descendant_id, r.levels) for r in H.all_descendants(found).collect()]
    want = distances(links)
    assert set(want) == {(u, v) for v, above in closure(links).items() for u in above if u != v}
    assert len(got) == len(want) and {(a, v): n for a, v, n in got} == want
    rows = H.full_hierarchy(found).collect()
    below = collections.Counter(a for a, _ in want)
    assert {r.entity_id: r.n_descendants for r in rows} == {r.entity_id: below[r.entity_id] for r in rows}


def test_all_descendants_by_hubs_and_without_extra_links(spark):
    rows = [(1, 5, "RelatingObject", 1), (2, 5, "RelatingObject", 2), (3, 5, "RelatedObjects", 3), (4, 5, "RelatedObjects", 4), (5, 6, "RelatingObject", 4), (6, 6, "RelatedObjects", 2)]
    for links, found in (([(1, 3), (1, 4), (2, 3), (2, 4), (4, 2)], tables(spark, None, rows=rows)), ([(1, 2), (2, 3)], tables(spark, [(1, 2), (2, 3)]))):
        got = H.all_descendants(H.hierarchy_links(*found)).collect()
        assert {(r.entity_id, r.descendant_id): r.levels for r in got} == distances(links)


def test_long_interlocked_loops_in_few_steps(spark, monkeypatch):
    """A ring of 5,000 with chords, rings in a row and a dense knot: the number of steps does not grow with them."""
    rng = random.Random(9)
    n = 5000
    links = [(i, (i + 1) % n) for i in range(n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(40)]
    links += [(10_000 + rng.randrange(300), 10_000 + rng.randrange(300)) for _ in range(1500)]
    for k in range(40):  # rings one below the other
        links += [(20_000 + 3 * k + i, 20_000 + 3 * k + (i + 1) % 3) for i in range(3)] + [(20_000 + 3 * k, 20_003 + 3 * k)]
    links = [(p, c) for p, c in links if p != c]
    cuts = []
    cut = H.Scratch.cut
    monkeypatch.setattr(H.Scratch, "cut", lambda self, *a, **k: cuts.append(1) or cut(self, *a, **k))
    found = spark.createDataFrame([(2 * c, 2 * p) for p, c in set(links)], "child long, parent long")
    got = {(r.entity_id, r.loop_id) for r in H.on_or_below_loops(found).collect()}
    ring = {(v, 0) for v in range(n)}
    chain = {(20_000 + 3 * k + i, 20_000 + 3 * j) for k in range(40) for i in range(3) for j in range(k + 1)} | {(20_120, 20_000 + 3 * j) for j in range(40)}
    knot = brute([(p, c) for p, c in links if 10_000 <= p < 20_000])
    assert {x for x in got if x[0] < 10_000} == ring and {x for x in got if 10_000 <= x[0] < 20_000} == knot and {x for x in got if x[0] >= 20_000} == chain
    assert len(cuts) < 300


def test_deep_chain_and_comb(spark):
    """Paths and descendants from intervals at a depth of 300, with leaves all along it, and entities without links."""
    links = [(i, i + 1) for i in range(1, 300)] + [(i, 1000 + i) for i in range(1, 300)]
    found = H.hierarchy_links(*tables(spark, links))
    ents = spark.createDataFrame([(i,) for i in {x for p in links for x in p} | {5000, 5001}] + [(None,), (5000,)], "id long")
    rows = {r.entity_id: r for r in H.full_hierarchy(found, ents).collect()}
    assert len(rows) == 601 and rows[300].path == list(range(1, 301)) and rows[1299].path == [*range(1, 300), 1299] and rows[1].n_descendants == 598
    assert rows[5000].path == [5000] and rows[5000].root_id == 5000 and rows[5000].depth == rows[5000].n_descendants == 0 and rows[5000].loop_id is None
    assert H.all_descendants(found).count() == sum(len(a) for a in closure(links).values())
