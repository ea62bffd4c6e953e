"""Parent-child links to full hierarchies (problem 2).

Leaves are peeled by contraction: nodes with one way on are skipped by pointer jumping, ways to ends are dropped,
and what branches is contracted again, so chains of any depth cost the logarithm of it. Peeling upward and then
downward exposes the loops, which are contracted to their smallest entity. Euler tours are built over the forest
and ranked by parallel pointer jumping; entry and exit intervals then give roots, depths, ancestors, paths and
descendants, by a join of aligned blocks of entries.

A relationship of several owners and several owned rows is held by a hub node (of no depth), so that its links
stay as many as its rows. Nodes are numbered entity * 2, hubs relationship * 2 + 1.

Defined results: rows without entity_id, of unknown entities or of other roles do not count; repeated rows and
re-imported relationships are one link; a node of several parents has the smallest as its tree parent and the
others as extra links, which loops and descendants are followed along too; an entity without links is a root of its own; an entity above which there is no loop has no
p2_found row; empty tables give empty results. Strongly connected groups of several interlocked loops count
as one loop of their smallest entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisq.runtime import Scratch

CLASSES = ("IfcRelAggregates", "IfcRelNests", "IfcRelContainedInSpatialStructure")


def hierarchy_links(members: DataFrame, relationships: DataFrame, entities: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Distinct links (child, parent) of nodes."""
    rels = relationships.where(F.lower("ifc_class").isin([c.lower() for c in classes])).select(F.col("id").alias("relationship_id")).where("relationship_id is not null")
    side = F.when(F.lower("role").startswith("relating"), "owner").when(F.lower("role").startswith("related"), "owned")
    known = entities.select(F.col("id").alias("entity_id")).where("entity_id is not null")
    rows = (
        members.where("entity_id is not null and relationship_id is not null")
        .select("relationship_id", "entity_id", side.alias("side"))
        .where("side is not null")
        .join(rels, "relationship_id", "left_semi")
        .join(known, "entity_id", "left_semi")
        .distinct()
    )
    sole = rows.where("side = 'owner'").groupBy("relationship_id").agg(F.count(F.lit(1)).alias("owners"), F.min("entity_id").alias("owner"))
    node = F.col("entity_id") * 2
    hub = F.col("relationship_id") * 2 + 1
    owned = rows.where("side = 'owned'").join(sole, "relationship_id").select(node.alias("child"), F.when(F.col("owners") == 1, F.col("owner") * 2).otherwise(hub).alias("parent"))
    hubs = rows.where("side = 'owner'").join(sole.where("owners > 1").select("relationship_id"), "relationship_id").select(hub.alias("child"), node.alias("parent"))
    return owned.unionByName(hubs).distinct()


def _ends(jump: DataFrame, s: Scratch) -> DataFrame:
    """Where single ways (a, top, loop) end, by pointer jumping: top is null and loop true for those that go round or into a loop."""
    before = None
    while True:  # four times as far a step
        far = jump.select("a", "top", "loop")
        for _ in range(3):
            on = jump.select(F.col("a").alias("b"), F.col("top").alias("top2"), F.col("loop").alias("loop2"))
            moved = F.col("b").isNotNull()
            far = far.join(on, F.col("top") == F.col("b"), "left").select("a", F.when(moved, F.col("top2")).otherwise(F.col("top")).alias("top"), (F.col("loop") | F.coalesce("loop2", F.lit(False))).alias("loop"), moved.alias("moved"))
        jump, moving = s.cut_counted(far, "moved", jump)
        if not moving:
            return jump.select("a", "top", "loop")
        if moving == before:  # no way has ended in the last step: those that still move go round
            return jump.select("a", F.when(~F.col("moved"), F.col("top")).alias("top"), (F.col("loop") | F.col("moved")).alias("loop"))
        before = moving


def _endless(links: DataFrame, start: str, end: str, s: Scratch) -> DataFrame:
    """Nodes (one column, a) from which walks of any length lead along distinct links from start to end: those on a loop or before one.

    Peeling by contraction: a node with one way on stands for the end of that way, found by pointer jumping, so chains
    of any depth cost the logarithm of it. Ways to ends are dropped. Of what branches, every node follows one of its
    ways: where that goes round, the node is endless and all its ways count as one into a loop (a null). The rest is
    contracted again.
    """
    edges, n = links.select(F.col(start).alias("a"), F.col(end).alias("b")), 1
    held: list[DataFrame] = []
    while n:
        ways, forks = s.cut_counted(edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("next"), F.bool_or(F.col("b").isNull()).alias("loop")), "n > 1 and not loop")
        sole = F.col("loop") | (F.col("n") == 1)
        jump = _ends(ways.where(sole).select("a", F.when(~F.col("loop"), F.col("next")).alias("top"), "loop"), s)
        held.append(jump)
        if not forks:
            break
        branching = ways.where(~sole).select("a")
        wide = edges.join(branching, "a", "left_semi").join(jump.select(F.col("a").alias("b"), "top", F.col("loop").alias("into")), "b", "left")
        to = wide.select("a", F.when(~F.coalesce("into", F.lit(False)), F.coalesce("top", "b")).alias("b"))
        kept, n = s.cut_counted(to.join(branching.select(F.col("a").alias("b"), F.lit(True).alias("on")), "b", "left").where("b is null or on").select("a", "b").distinct())
        if n:
            pick = kept.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("top"), F.bool_or(F.col("b").isNull()).alias("loop"))
            round_ = _ends(s.cut(pick.select("a", F.when(~F.col("loop"), F.col("top")).alias("top"), "loop")), s).where("loop").select("a", "loop")
            edges, n = s.cut_counted(kept.join(round_, "a", "left").select("a", F.when(F.col("loop").isNull(), F.col("b")).alias("b")).distinct())
    left = links.select(F.col(start).alias("a")).where("false")
    for k, jump in enumerate(reversed(held)):
        left = left.union(jump.join(left.select(F.col("a").alias("t")), F.col("top") == F.col("t"), "left").where("loop or t is not null").select("a"))
        if 0 < k < len(held) - 1:
            left = s.cut(left)
    return left


def _within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links both ends of which are among the nodes (one column, a)."""
    return links.join(nodes.select(F.col("a").alias("child")), "child", "left_semi").join(nodes.select(F.col("a").alias("parent")), "parent", "left_semi").select("child", "parent")


def _loops(core: DataFrame, s: Scratch) -> DataFrame:
    """(node, loop) of the strongly connected groups with a loop among links that are neither head nor tail.

    In each round every node points at one of its parents and at one of its children, by hash. Pointer jumping leads
    it to a ring of parents above and to one of children below, if not to an end. Rings are contracted, and so is each
    node between two rings that share a node. The number of rounds does not depend on the length of a loop.
    """
    group = s.cut(core.select(F.col("child").alias("node")).union(core.select("parent")).distinct().withColumn("rep", F.col("node")))
    rest, n = s.cut_counted(core.where("child <> parent").select("child", "parent").distinct())
    salt, trim = 0, bool(core.where("child = parent").take(1))
    while n:
        if trim:  # what is left is no longer halved: its heads and tails are peeled
            rest = s.cut(_within(rest, _endless(rest, "child", "parent", s)))
            rest, n = s.cut_counted(_within(rest, _endless(rest, "parent", "child", s)))
            if not n:
                break
        salt += 1
        pick = lambda v, w: F.min(F.struct(F.xxhash64(F.col(w), F.lit(salt)).alias("h"), F.col(w).alias("w")))["w"]
        up = rest.groupBy(F.col("child").alias("v")).agg(pick("child", "parent").alias("next")).withColumn("way", F.lit(0))
        down = rest.groupBy(F.col("parent").alias("v")).agg(pick("parent", "child").alias("next")).withColumn("way", F.lit(1))
        walk, count = s.cut_counted(up.unionByName(down).withColumn("low", F.least("v", "next")), "way = 0")
        reach = 1
        while reach < count:  # four times as far a round
            for k in range(3):
                on = walk.select("way", F.col("v").alias(f"at{k}"), F.col("next").alias(f"next{k}"), F.col("low").alias(f"low{k}"))
                far = _follow(walk if k == 0 else far, on, k)
            walk = s.cut(far, walk)
            reach *= 4
        ring = s.cut(walk.select("way", F.col("next").alias("v")).distinct().join(walk.select("way", "v", F.col("low").alias("ring")), ["way", "v"]))
        known = walk.select("way", "v", "next").join(ring.select("way", F.col("v").alias("next"), F.col("ring").alias("basin")), ["way", "next"]).join(ring, ["way", "v"], "left")
        of = lambda way, c: F.max(F.when(F.col("way") == way, F.col(c)))
        both = s.cut(known.groupBy("v").agg(of(0, "basin").alias("a"), of(1, "basin").alias("b"), of(0, "ring").alias("on_a"), of(1, "ring").alias("on_b")))
        shared = both.where("on_a is not null and on_b is not null").select(F.col("on_a").alias("sa"), F.col("on_b").alias("sb")).distinct()
        first = shared.groupBy(F.col("sb").alias("fb")).agg(F.min("sa").alias("fa"))
        label = s.cut(
            both.join(shared, (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb")), "left")
            .join(first, F.col("on_b") == F.col("fb"), "left")
            .select(F.col("v").alias("rep"), F.coalesce("on_a", F.when(F.col("on_b").isNotNull(), F.coalesce("fa", "on_b")), "sa", "v").alias("label"))
        )
        group = s.cut(group.join(label, "rep", "left").select("node", F.coalesce("label", "rep").alias("rep")), group)
        lc, lp = label.select(F.col("rep").alias("child"), F.col("label").alias("lc")), label.select(F.col("rep").alias("parent"), F.col("label").alias("lp"))
        moved = rest.join(lc, "child", "left").join(lp, "parent", "left").select(F.coalesce("lc", "child").alias("child"), F.coalesce("lp", "parent").alias("parent"))
        before, moved = n, moved.where("child <> parent").distinct()
        rest, n = s.cut_counted(moved, replaces=rest)
        trim = 2 * n > before
    alone = core.where("child = parent").select(F.col("child").alias("node")).join(group, "node").select("rep")
    real = group.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep").union(alone).distinct()
    return group.join(real, "rep", "left_semi").select("node", F.col("rep").alias("loop"))


def _follow(walk: DataFrame, on: DataFrame, k: int) -> DataFrame:
    """One pointer further, with the smallest node met; where there is none the walk stays."""
    ahead = on.withColumnRenamed("way", "w2")
    return walk.join(ahead, (F.col("way") == F.col("w2")) & (F.col("next") == F.col(f"at{k}")), "left").select("way", "v", F.coalesce(f"next{k}", "next").alias("next"), F.least("low", f"low{k}").alias("low"))


def _siblings(tree: DataFrame, s: Scratch) -> DataFrame:
    """(v, parent, first, next): whether v is its parent's first child, and the next child.

    The order is by a range-partitioned sort, so the children of one huge parent spread over tasks.
    """
    order = s.cut(tree.repartitionByRange("parent", "v").sortWithinPartitions("parent", "v").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = order.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # one row per partition
    offset, base = {}, 0
    for r in counts:
        offset[r.p] = base
        base += r.n
    if not offset:
        return order.select("v", "parent", F.lit(True).alias("first"), F.lit(None).cast("long").alias("next"))
    table = F.create_map(*(x for p, o in offset.items() for x in (F.lit(p), F.lit(o))))
    placed = order.select("v", "parent", (table[part] + F.col("at").bitwiseAND((1 << 33) - 1)).alias("i"))
    after = placed.select((F.col("i") - 1).alias("i"), F.col("v").alias("next"), F.col("parent").alias("np"))
    before = placed.select((F.col("i") + 1).alias("i"), F.col("parent").alias("pp"))
    return (
        placed.join(after, "i", "left")
        .join(before, "i", "left")
        .select("v", "parent", F.coalesce(F.col("pp") != F.col("parent"), F.lit(True)).alias("first"), F.when(F.col("np") == F.col("parent"), F.col("next")).alias("next"))
    )


def euler_tours(tree: DataFrame, roots: DataFrame, s: Scratch) -> DataFrame:
    """(v, root, depth, entry, exit, size, total) of a forest given as (v, parent) and roots (v).

    Each node has an arc down into it and one up out of it; the tour of a tree is the list of its arcs. The
    list is ranked by pointer jumping: distance to its end, weight and entities to its end and the end itself.
    Hubs weigh 0; size counts the entities in a subtree, total the arcs of the tour.
    """
    sib = s.cut(_siblings(tree, s))
    nodes = tree.select("v", "parent").unionByName(roots.select("v", F.lit(None).cast("long").alias("parent")))
    firsts = sib.where("first").select(F.col("parent").alias("fp"), F.col("v").alias("fc"))
    nexts = sib.select(F.col("v").alias("nv"), "next")
    base = nodes.join(firsts, F.col("v") == F.col("fp"), "left").join(nexts, F.col("v") == F.col("nv"), "left")
    weight = F.when(F.pmod("v", F.lit(2)) == 0, 1).otherwise(0)
    down = base.select((F.col("v") * 2).alias("arc"), F.coalesce(F.col("fc") * 2, F.col("v") * 2 + 1).alias("next"), weight.alias("w"), weight.alias("real"))
    up = base.select((F.col("v") * 2 + 1).alias("arc"), F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1).alias("next"), (-weight).alias("w"), F.lit(0).alias("real"))
    # rank: arcs from here to the end of the list, this one included; w: their weight; end: the last arc seen.
    ranked, moving = s.cut_counted(down.unionByName(up).select("arc", "next", F.lit(1).cast("long").alias("rank"), F.col("w").cast("long"), F.col("real").cast("long"), F.col("arc").alias("end")), "next is not null")
    while moving:
        ahead = ranked.select(F.col("arc").alias("next"), F.col("next").alias("next2"), F.col("rank").alias("rank2"), F.col("w").alias("w2"), F.col("real").alias("real2"), F.col("end").alias("end2"))
        sums = [(F.col(c) + F.col(f"{c}2")).alias(c) for c in ("rank", "w", "real")]
        jumped = ranked.where("next is not null").join(ahead, "next").select("arc", F.col("next2").alias("next"), *sums, F.col("end2").alias("end"))
        ranked, moving = s.cut_counted(jumped.unionByName(ranked.where("next is null")), "next is not null", ranked)
    side = F.pmod("arc", F.lit(2))
    v = F.shiftright("arc", 1)
    per = ranked.select(v.alias("v"), side.alias("side"), "rank", "w", "real", F.shiftright("end", 1).alias("root"))
    both = per.where("side = 0").select("v", "root", F.col("rank").alias("entry_left"), "w", "real").join(per.where("side = 1").select("v", F.col("rank").alias("exit_left"), F.col("real").alias("real_after")), "v")
    total = both.where("v = root").select("root", F.col("entry_left").alias("total"))
    # From a node's arc down to the end of the tour all weights cancel but those up out of its ancestors.
    return both.join(total, "root").select(
        "v", "root", (-F.col("w")).alias("depth"), (F.col("total") - F.col("entry_left")).alias("entry"), (F.col("total") - F.col("exit_left")).alias("exit"), (F.col("real") - F.col("real_after")).alias("size"), "total"
    )


#: Entries of a tour are grouped in aligned blocks of 8, 64, 512, ...; a tour of any length has its last level undivided.
_LEVELS = 14


def _cover(lo: str, hi: str) -> Column:
    """The fewest aligned blocks (level, block) that make up the entries from lo to hi: at most 14 a level."""
    parts = []
    for k in range(_LEVELS):
        low, high = f"shiftright({lo} + {8**k - 1}L, {3 * k})", f"(shiftright({hi} + 1, {3 * k}) - 1)"
        low2, high2 = f"shiftright({lo} + {8 ** (k + 1) - 1}L, {3 * k + 3})", f"(shiftright({hi} + 1, {3 * k + 3}) - 1)"
        of = lambda a, b: f"case when {a} <= {b} then transform(sequence({a}, {b}), x -> struct({k} as level, x as block)) else cast(array() as array<struct<level:int,block:bigint>>) end"  # noqa: B023, E731
        whole = of(low, high)
        parts.append(whole if k == _LEVELS - 1 else f"case when {low} > {high} then cast(array() as array<struct<level:int,block:bigint>>) when {low2} > {high2} then {whole} else concat({of(low, f'{low2} * 8 - 1')}, {of(f'({high2} + 1) * 8', high)}) end")
    return F.expr(f"concat({', '.join(parts)})")


def below(above: DataFrame, tours: DataFrame) -> DataFrame:
    """Joins intervals (root, lo, hi and further columns) with the tours' nodes whose entry lies within them.

    Each interval is cut into aligned blocks, each entry lies in one block a level, and a pair meets in exactly one
    block: an equality join whose cost is that of its input and output, with no key that grows with a tree.
    """
    blocks = above.withColumn("k", F.explode(_cover("lo", "hi"))).withColumn("level", F.col("k.level")).withColumn("block", F.col("k.block")).drop("k", "lo", "hi")
    places = F.expr("transform(sequence(0, cast((length(bin(total)) - 1) div 3 as int)), k -> struct(k as level, shiftright(entry, 3 * k) as block))")
    nodes = tours.select("root", "v", F.col("depth").alias("v_depth"), F.explode(places).alias("k")).select("root", "v", "v_depth", F.col("k.level").alias("level"), F.col("k.block").alias("block"))
    return blocks.join(nodes, ["root", "level", "block"]).drop("root", "level", "block")


def _ancestors(tours: DataFrame) -> DataFrame:
    """(a, v, a_depth, levels) of each node and those above it in the forest, from the entry and exit intervals."""
    inner = tours.where("exit > entry + 1").select("root", F.col("v").alias("a"), F.col("depth").alias("a_depth"), (F.col("entry") + 1).alias("lo"), (F.col("exit") - 1).alias("hi"))
    return below(inner, tours).select("a", "v", "a_depth", (F.col("v_depth") - F.col("a_depth")).cast("int").alias("levels"))


def find_loops(links: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links on or below loops, (node, loop) of the nodes on loops, loop being the smallest entity's node)."""
    under = s.cut(_within(links, _endless(links, "child", "parent", s)))
    core = s.cut(_within(under, _endless(under, "parent", "child", s)))
    member = _loops(core, s)
    name = member.where(F.pmod("node", F.lit(2)) == 0).groupBy("loop").agg(F.min("node").alias("head"))
    return under, s.cut(member.join(name, "loop").select("node", F.col("head").alias("loop")))


def on_or_below_loops(links: DataFrame) -> DataFrame:
    """(entity_id, loop_id) of each entity that is its own ancestor or has an ancestor that is."""
    s = Scratch(links.sparkSession, "loops")
    links = s.cut(links)
    under, loops = find_loops(links, s)
    if not loops.take(1):
        return s.finish(loops.select(F.col("node").alias("entity_id"), F.col("loop").alias("loop_id")))
    # Contract: members of a loop hang from its head; what is below keeps its smallest parent, the rest are extra links.
    lc, lp = loops.select(F.col("node").alias("child"), F.col("loop").alias("cl")), loops.select(F.col("node").alias("parent"), F.col("loop").alias("pl"))
    marked = under.join(lc, "child", "left").join(lp, "parent", "left").select("child", "parent", "cl", "pl")
    outer = marked.where("cl is null").select("child", F.coalesce("pl", "parent").alias("parent")).distinct()
    tree_low = outer.groupBy("child").agg(F.min("parent").alias("parent")).select(F.col("child").alias("v"), "parent")
    inner = loops.where("node <> loop").select(F.col("node").alias("v"), F.col("loop").alias("parent"))
    tree = s.cut(tree_low.unionByName(inner))
    roots = loops.select(F.col("loop").alias("v")).distinct()
    tours = s.cut(euler_tours(tree, roots, s))
    extra = outer.join(tree_low.select(F.col("v").alias("child"), F.col("parent").alias("tp")), "child").where("parent <> tp").select("child", "parent").unionByName(
        marked.where("cl is not null and (pl is null or pl <> cl)").select(F.col("cl").alias("child"), F.coalesce("pl", "parent").alias("parent"))
    ).distinct()
    extra, n = s.cut_counted(extra)
    reach = tours.select("v", F.col("root").alias("loop"))
    if n:
        # Loops that come in along an extra link cover the whole interval below it.
        gate = s.cut(tours.join(extra.select(F.col("child").alias("v")).distinct(), "v").select("root", F.col("v").alias("c"), F.col("entry").alias("lo"), F.col("exit").alias("hi")))
        ends = s.cut(tours.join(extra.select(F.col("parent").alias("v")).distinct(), "v"))
        come = ends.select(F.col("v").alias("parent"), F.col("root").alias("x")).join(extra, "parent").select("x", F.col("child").alias("y"))
        through = below(gate, ends).select(F.col("c").alias("x"), F.col("v").alias("parent")).join(extra, "parent").select("x", F.col("child").alias("y"))
        hop, fresh = s.cut_counted(come.union(through).distinct())
        while True:  # which gates open into which, by doubling
            far = hop.join(hop.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y"))
            hop, now = s.cut_counted(hop.union(far).distinct(), replaces=hop)
            if now == fresh:
                break
            fresh = now
        arrive = hop.join(roots.select(F.col("v").alias("x")), "x").select(F.col("y").alias("c"), F.col("x").alias("loop"))
        reach = reach.union(below(gate.join(arrive, "c").drop("c"), tours).select("v", "loop")).distinct()
    return s.finish(reach.where(F.pmod("v", F.lit(2)) == 0).select(F.expr("v div 2").alias("entity_id"), F.expr("loop div 2").alias("loop_id")))


def _tree(links: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """((v, parent, n_parents) of every node with a tree parent, (node, loop) of the nodes on loops).

    The tree parent is the one of the smallest entity: a hub counts as its smallest owner.
    """
    _, loops = find_loops(links, s)
    heads = loops.select(F.col("loop").alias("child")).distinct()
    lc, lp = loops.select(F.col("node").alias("child"), F.col("loop").alias("cl")), loops.select(F.col("node").alias("parent"), F.col("loop").alias("pl"))
    marked = links.join(lc, "child", "left").join(lp, "parent", "left")
    # Of a node on a loop only a parent on the same loop counts, of its head none.
    kept = s.cut(marked.where("cl is null or cl = pl").join(heads, "child", "left_anti").select("child", "parent"))
    owners = kept.where(F.pmod("child", F.lit(2)) == 1).select(F.col("child").alias("parent"), F.col("parent").alias("owner"))
    ranked = kept.join(owners, "parent", "left").withColumn("owner", F.coalesce("owner", "parent"))
    tree = ranked.groupBy("child").agg(F.min(F.struct("owner", "parent"))["parent"].alias("parent"), F.countDistinct("owner").alias("n_parents"))
    tree = s.cut(tree.select(F.col("child").alias("v"), "parent", "n_parents"))
    if loops.where("node <> loop").take(1):
        tree = s.cut(_unknot(tree, loops, s), tree)
    return tree, loops


def _nodes(links: DataFrame) -> DataFrame:
    return links.select(F.col("child").alias("v")).union(links.select("parent")).distinct()


def _even(node: Column) -> Column:
    """1 for an entity, 0 for a hub."""
    return F.when(F.pmod(node, F.lit(2)) == 0, 1).otherwise(0)


def _toured(links: DataFrame, tree: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(tours, ancestors) of the forest over all nodes of the links."""
    roots = s.cut(_nodes(links).join(tree.select("v"), "v", "left_anti"))
    tours = s.cut(euler_tours(tree.select("v", "parent"), roots, s))
    return tours, s.cut(_ancestors(tours))


def _off_tree(links: DataFrame, tree: DataFrame, above: DataFrame, s: Scratch) -> DataFrame | None:
    """(a, v, levels) of the nodes and those below them on ways that are not the tree's alone, with the fewest levels.

    The links that are not in the tree are extra: further parents and those that close loops. All that is above an
    extra parent arrives at its child, thence at the children of extra links below it (closed by doubling), and
    counts for the whole subtrees of them. None if there are no extra links.
    """
    extra, n = s.cut_counted(links.select(F.col("child").alias("c"), "parent").join(tree.select(F.col("v").alias("c"), "parent"), ["c", "parent"], "left_anti"))
    if not n:
        return None
    children = s.cut(extra.select("c").distinct())
    selves = lambda ids: ids.select("id", F.col("id").alias("of"), F.lit(0).alias("levels"))
    ends = extra.select(F.col("parent").alias("v")).distinct()
    parents = above.join(ends, "v", "left_semi").select("a", "v", "levels").union(selves(ends.withColumnRenamed("v", "id")))
    arrive = s.cut(extra.join(parents, F.col("parent") == F.col("v")).groupBy("a", "c").agg(F.min(F.col("levels") + _even(F.col("parent"))).alias("levels")))
    hop, fresh = s.cut_counted(arrive.join(children.select(F.col("c").alias("a")), "a", "left_semi"))
    while fresh:
        on = hop.select(F.col("a").alias("c"), F.col("c").alias("c2"), F.col("levels").alias("levels2"))
        far = hop.join(on, "c").select("a", F.col("c2").alias("c"), (F.col("levels") + F.col("levels2")).alias("levels"), F.lit(None).cast("int").alias("old"))
        least = far.unionByName(hop.select("a", "c", "levels", F.col("levels").alias("old"))).groupBy("a", "c").agg(F.min("levels").alias("levels"), F.min("old").alias("old"))
        hop, fresh = s.cut_counted(least.select("a", "c", "levels", (F.col("old").isNull() | (F.col("levels") < F.col("old"))).alias("fresh")), "fresh", hop)
    on = hop.select(F.col("a").alias("c"), F.col("c").alias("c2"), F.col("levels").alias("levels2"))
    further = arrive.join(on, "c").select("a", F.col("c2").alias("c"), (F.col("levels") + F.col("levels2")).alias("levels"))
    arrive = s.cut(arrive.unionByName(further).where("a % 2 = 0").groupBy("a", "c").agg(F.min("levels").alias("levels")), arrive)
    under = above.join(children.select(F.col("c").alias("a")), "a", "left_semi").select("a", "v", "levels").union(selves(children.withColumnRenamed("c", "id")))
    under = under.where("v % 2 = 0").select(F.col("a").alias("c"), "v", F.col("levels").alias("levels2"))
    return s.cut(arrive.join(under, "c").where("a <> v").groupBy("a", "v").agg(F.min(F.col("levels") + F.col("levels2")).alias("levels")))


def _real(tree: DataFrame, links: DataFrame) -> DataFrame:
    """The tree's parents that are links; in interlocked loops some are not."""
    return tree.select("v", "parent").join(links.select(F.col("child").alias("v"), "parent"), ["v", "parent"], "left_semi")


def _pairs(links: DataFrame, tree: DataFrame, above: DataFrame, s: Scratch) -> DataFrame:
    """(a, v, levels) of entities and all entities below them by whatever parents."""
    within = above.where("a % 2 = 0 and v % 2 = 0").select("a", "v", "levels")
    off = _off_tree(links, tree, above, s)
    if off is None:
        return within
    # Only nodes with something off the tree above them have pairs to be merged.
    merged = s.cut(off.select("v").distinct())
    both = within.join(merged, "v", "left_semi").select("a", "v", "levels").unionByName(off).groupBy("a", "v").agg(F.min("levels").alias("levels"))
    return within.join(merged, "v", "left_anti").select("a", "v", "levels").unionByName(both)


def all_descendants(links: DataFrame) -> DataFrame:
    """(entity_id, descendant_id, levels): every entity below each by whatever parents, with the fewest levels between.

    The members of a loop are descendants of each other and have what is below any of them; none is its own.
    """
    s = Scratch(links.sparkSession, "descendants")
    links = s.cut(links)
    tree = s.cut(_real(_tree(links, s)[0], links))
    pairs = _pairs(links, tree, _toured(links, tree, s)[1], s)
    return s.finish(pairs.select(F.expr("a div 2").alias("entity_id"), F.expr("v div 2").alias("descendant_id"), "levels"))


def full_hierarchy(links: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """The rows of ``hierarchy`` with n_descendants by whatever parents, as ``all_descendants`` has them.

    With the entities, those without any link have a row too, as roots of their own.
    """
    s = Scratch(links.sparkSession, "hierarchy")
    links = s.cut(links)
    tree, loops = _tree(links, s)
    tours, above = _toured(links, tree, s)
    rows = _rows(tours, above, tree, loops)
    real, n_real = s.cut_counted(_real(tree, links))
    if n_real < tree.count():
        above = _toured(links, real, s)[1]
    n = _pairs(links, real, above, s).groupBy(F.expr("a div 2").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_descendants"))
    out = rows.drop("n_descendants").join(n, "entity_id", "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0))).select(rows.columns)
    if entities is not None:
        alone = entities.select(F.col("id").cast("long").alias("entity_id")).where("entity_id is not null").distinct().join(_nodes(links).select(F.expr("v div 2").alias("entity_id")).where("v % 2 = 0"), "entity_id", "left_anti")
        filled = {"root_id": F.col("entity_id"), "depth": F.lit(0), "path": F.array("entity_id"), "entry": F.lit(0), "exit": F.lit(1), "n_descendants": F.lit(0), "n_parents": F.lit(0)}
        out = out.unionByName(alone.select("entity_id", *((filled.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in out.schema if f.name != "entity_id")))
    return s.finish(out)


def hierarchy(links: DataFrame) -> DataFrame:
    """entity_id, parent_id, root_id, depth, path, entry, exit, n_descendants, n_parents, loop_id of every node.

    Loops are cut above their smallest entity, which becomes the root of what is on and below the loop; loop_id
    marks the nodes on loops. ``path`` runs from the root to the node. The descendants of a node in the tree, which
    n_descendants counts, are the nodes of its root with entry within (entry, exit); those by other parents and
    around loops are in ``all_descendants``, and counted by ``full_hierarchy``.
    """
    s = Scratch(links.sparkSession, "hierarchy")
    links = s.cut(links)
    tree, loops = _tree(links, s)
    tours, above = _toured(links, tree, s)
    return s.finish(_rows(tours, above, tree, loops))


def _rows(tours: DataFrame, above: DataFrame, tree: DataFrame, loops: DataFrame) -> DataFrame:
    """The rows of ``hierarchy``: a node's path is its ancestors, those whose intervals hold it, by depth."""
    ups = above.where("a % 2 = 0 and v % 2 = 0").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("a_depth", F.expr("a div 2").alias("id")))).alias("ups"))
    own_path = F.concat(F.coalesce(F.col("ups")["id"], F.array().cast("array<bigint>")), F.array(F.expr("v div 2")))
    return (
        tours.where("v % 2 = 0")
        .join(ups, "v", "left")
        .join(tree, "v", "left")
        .join(loops.select(F.col("node").alias("v"), F.col("loop").alias("lp")), "v", "left")
        .withColumn("own_path", own_path)
        .select(
            F.expr("v div 2").alias("entity_id"),
            F.try_element_at("own_path", F.lit(-2)).alias("parent_id"),
            F.element_at("own_path", 1).alias("root_id"),
            "depth",
            F.col("own_path").alias("path"),
            "entry",
            "exit",
            (F.col("size") - 1).alias("n_descendants"),
            F.coalesce("n_parents", F.lit(0)).alias("n_parents"),
            F.when(F.pmod("lp", F.lit(2)) == 0, F.expr("lp div 2")).alias("loop_id"),
        )
    )


def _unknot(tree: DataFrame, loops: DataFrame, s: Scratch) -> DataFrame:
    """Trees must have no loop: in interlocked loops the smallest parents may still form one; such members hang from the head."""
    left = _endless(tree.select(F.col("v").alias("child"), "parent"), "child", "parent", s)
    stuck = left.select(F.col("a").alias("v")).join(loops.select(F.col("node").alias("v"), F.col("loop").alias("h")), "v")
    return tree.join(stuck, "v", "left").select("v", F.coalesce("h", "parent").alias("parent"), "n_parents")


def descendants(nodes: DataFrame) -> DataFrame:
    """(entity_id, descendant_id, levels) from the rows of ``hierarchy``, in the tree alone: every node below every node of its path."""
    at = nodes.select(F.col("entity_id").alias("descendant_id"), "depth", F.posexplode("path").alias("level", "entity_id"))
    return at.where("level < depth").select("entity_id", "descendant_id", (F.col("depth") - F.col("level")).alias("levels"))
