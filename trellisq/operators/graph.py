"""Bounded traversal over role-labelled relationships of many ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.model import MAX_HOPS, MAX_LIMIT, PlanError
from trellisq.runtime import Scratch

#: Relationship class, semantic role, relating roles, related roles. Fixed values.
REGISTRY = (
    ("IfcRelContainedInSpatialStructure", "containment", ("RelatingStructure",), ("RelatedElements",)),
    ("IfcRelAggregates", "aggregation", ("RelatingObject",), ("RelatedObjects",)),
    ("IfcRelDefinesByType", "type_definition", ("RelatingType",), ("RelatedObjects",)),
    ("IfcRelDefinesByProperties", "property_definition", ("RelatingPropertyDefinition",), ("RelatedObjects",)),
    ("IfcRelAssociatesMaterial", "material_association", ("RelatingMaterial",), ("RelatedObjects",)),
    ("IfcRelVoidsElement", "opening_filling", ("RelatingBuildingElement",), ("RelatedOpeningElement",)),
    ("IfcRelFillsElement", "opening_filling", ("RelatingOpeningElement",), ("RelatedBuildingElement",)),
    ("IfcRelAssignsToGroup", "grouping", ("RelatingGroup",), ("RelatedObjects",)),
    ("IfcRelSpaceBoundary", "boundary", ("RelatingSpace",), ("RelatedBuildingElement",)),
    ("IfcRelConnectsElements", "connection", ("RelatingElement",), ("RelatedElement",)),
    ("IfcRelConnectsPathElements", "connection", ("RelatingElement",), ("RelatedElement",)),
    ("IfcRelAssignsTasks", "process_relationship", ("RelatingControl",), ("RelatedObjects", "TimeForTask")),
    ("IfcRelAssignsToProcess", "process_relationship", ("RelatingProcess",), ("RelatedObjects",)),
    ("IfcRelSequence", "process_relationship", ("RelatingProcess",), ("RelatedProcess",)),
)
MAX_SEEDS = 50
MAX_TOPOLOGY_HOPS = 2000
MAX_CONTEXT = 200
NODES, EDGES = (4, 24), 40
HOP = ["depth", "relationship_id", "rel_class", "semantic_role", "direction", "from_id", "from_role", "to_id", "to_role"]


def registry(spark, classes: tuple[str, ...] | None = None) -> tuple[DataFrame, list[str]]:
    """The registry's role pairs in both directions, and the classes asked for that it doesn't know."""
    known = {r[0] for r in REGISTRY}
    unknown = sorted(set(classes or ()) - known)
    rows = []
    for cls, role, relating, related in REGISTRY:
        if classes is None or cls in classes:
            for a in relating:
                for b in related:
                    rows += [(cls, role, "outgoing", a.lower(), b.lower()), (cls, role, "incoming", b.lower(), a.lower())]
    return spark.createDataFrame(rows, "rel_class string, semantic_role string, direction string, from_key string, to_key string"), unknown


def members_of(members: DataFrame, relationships: DataFrame, model: int) -> DataFrame:
    """The ends that a walk through a model can use: relationship_id, rel_class, member, role and entity_id."""
    own = members.where((F.col("source_model_id") == model) & F.col("entity_id").isNotNull()).select("relationship_id", F.col("id").alias("member"), "role", "entity_id")
    r = relationships.where(F.col("source_model_id") == model).select(F.col("id").alias("relationship_id"), F.col("ifc_class").alias("rel_class"))
    return own.join(r, "relationship_id")


def _step(frontier: DataFrame, ends: DataFrame, reg: DataFrame) -> DataFrame:
    """One hop from each entity of the frontier over the rows of ``members_of``. The registry is of fixed size."""
    f = ends.select("relationship_id", "rel_class", F.col("member").alias("f_member"), F.col("role").alias("from_role"), F.col("entity_id").alias("from_id")).join(frontier.select(F.col("id").alias("from_id")), "from_id")
    t = ends.select("relationship_id", F.col("member").alias("t_member"), F.col("role").alias("to_role"), F.col("entity_id").alias("to_id"))
    started = f.join(F.broadcast(reg.withColumnRenamed("rel_class", "reg_class")), (F.lower("from_role") == F.col("from_key")) & (F.col("rel_class") == F.col("reg_class")))
    hops = started.join(t, "relationship_id").where((F.lower("to_role") == F.col("to_key")) & (F.col("f_member") != F.col("t_member")) & (F.col("from_id") != F.col("to_id")))
    return hops.select("relationship_id", "rel_class", "semantic_role", "direction", "from_id", "from_role", "to_id", "to_role").distinct()


def _ways(reg: DataFrame, direction: str) -> DataFrame:
    if direction not in ("both", "outgoing", "incoming"):
        raise PlanError(f"no direction {direction}")
    return reg if direction == "both" else reg.where(F.col("direction") == direction)


def expand(frontier: DataFrame, members: DataFrame, relationships: DataFrame, model: int, reg: DataFrame, direction: str = "both") -> DataFrame:
    """One hop from each entity of the frontier (one column, id)."""
    return _step(frontier, members_of(members, relationships, model), _ways(reg, direction))


def traverse(seeds: DataFrame, members: DataFrame, relationships: DataFrame, model: int, depth: int, classes: tuple[str, ...] | None = None, direction: str = "both") -> tuple[DataFrame, list[str]]:
    """All hops of a breadth-first walk; entities reached before are not expanded again. Unknown classes are warned of.

    The model's ends are read once; a level is cut when a further one follows from it.
    """
    if not 0 <= depth <= MAX_HOPS:
        raise PlanError(f"depth 0 to {MAX_HOPS}")
    spark = seeds.sparkSession
    s = Scratch(spark, "traverse")
    reg, unknown = registry(spark, classes)
    reg = _ways(reg, direction)
    frontier = seeds.select("id").where("id is not null").distinct()
    ends = members_of(members, relationships, model)
    if depth > 1:
        frontier, ends = s.cut(frontier), s.cut(ends)
    visited, hops = frontier, None
    for level in range(1, depth + 1):
        step = _step(frontier, ends, reg).withColumn("depth", F.lit(level)).select(*HOP)
        if depth > 1:
            step = s.cut(step)
        hops = step if hops is None else hops.unionByName(step)
        frontier = step.select(F.col("to_id").alias("id")).distinct().join(visited, "id", "left_anti")
        visited = visited.union(step.select("to_id"))
    if hops is None:
        hops = spark.createDataFrame([], "depth int, relationship_id long, rel_class string, semantic_role string, direction string, from_id long, from_role string, to_id long, to_role string")
    return hops, [f"relationship class {c} is not supported" for c in unknown]


def reached(hops: DataFrame, seeds: DataFrame) -> DataFrame:
    """Entities reached with their smallest depth, seeds left out."""
    return hops.groupBy(F.col("to_id").alias("id")).agg(F.min("depth").alias("depth")).join(seeds.select("id"), "id", "left_anti")


def seeds_of(rows: DataFrame, limit: int = MAX_SEEDS) -> DataFrame:
    """Seeds from the same predicate as the count: the smallest ids of it."""
    return rows.select("id").orderBy("id").limit(limit)


def endpoints(hops: DataFrame, seeds: DataFrame, entities: DataFrame, classes: tuple[str, ...] = ()) -> DataFrame:
    """Entities at the ends of hops, of the classes asked for."""
    ends = entities.select("id", "global_id", "ifc_class").join(reached(hops, seeds), "id")
    return ends.where(F.col("ifc_class").isin(list(classes))) if classes else ends


def connections(hops: DataFrame) -> DataFrame:
    """Distinct connections, relating end first whichever way they were found."""
    out = F.col("direction") == "outgoing"
    pick = lambda a, b, name: F.when(out, F.col(a)).otherwise(F.col(b)).alias(name)
    return hops.select("relationship_id", "rel_class", "semantic_role", pick("from_id", "to_id", "src_id"), pick("from_role", "to_role", "src_role"), pick("to_id", "from_id", "dst_id"), pick("to_role", "from_role", "dst_role")).distinct()


def _node_keys(hops: DataFrame, seeds: DataFrame, entities: DataFrame) -> DataFrame:
    """The group of each entity: the seeds, or its class, relationship class and role at its first appearance."""
    ends = hops.select(F.col("to_id").alias("id"), "rel_class", F.col("to_role").alias("role"), "depth").join(seeds.select("id"), "id", "left_anti")
    first = ends.groupBy("id").agg(F.min(F.struct("depth", "rel_class", "role")).alias("m")).select("id", "m.rel_class", "m.role")
    keyed = first.join(entities.select("id", "ifc_class"), "id").select("id", F.concat_ws("|", "ifc_class", "rel_class", "role").alias("node"))
    return keyed.unionByName(seeds.select("id", F.lit("SEED").alias("node")))


def topology(hops: DataFrame, seeds: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grouped nodes (node_id, node, n_entities) and edges (edge_id, source, target, rel_class, n_connections)."""
    from pyspark.sql import Window

    keys = _node_keys(hops, seeds, entities)
    nodes = keys.groupBy("node").agg(F.countDistinct("id").alias("n_entities"))
    # The order is over groups, of which there are as many as classes and roles.
    number = F.row_number().over(Window.orderBy(F.col("node") != "SEED", F.desc("n_entities"), "node")) - 1
    nodes = nodes.withColumn("node_id", F.concat(F.lit("n"), number))
    c = connections(hops)
    s = keys.select(F.col("id").alias("src_id"), F.col("node").alias("source"))
    t = keys.select(F.col("id").alias("dst_id"), F.col("node").alias("target"))
    edges = c.join(s, "src_id").join(t, "dst_id").groupBy("source", "target", "rel_class").agg(F.countDistinct("relationship_id", "src_id", "dst_id").alias("n_connections"))
    edges = edges.withColumn("edge_id", F.concat(F.lit("e"), F.row_number().over(Window.orderBy(F.desc("n_connections"), "source", "target", "rel_class")) - 1))
    return nodes.select("node_id", "node", "n_entities"), edges.select("edge_id", "source", "target", "rel_class", "n_connections")


def presentable(nodes: int, edges: int, hops: int) -> str:
    """graph within the display bounds, else table."""
    return "graph" if NODES[0] <= nodes <= NODES[1] and edges <= EDGES and hops <= MAX_TOPOLOGY_HOPS else "table"


def get_relationship(relationships: DataFrame, model: int, relationship_id: int | None = None, global_id: str | None = None) -> DataFrame:
    """One relationship by id, or those of a global id (re-imports repeat it)."""
    if (relationship_id is None) == (global_id is None):
        raise PlanError("exactly one of id and global_id")
    rows = relationships.where(F.col("source_model_id") == model)
    return rows.where(F.col("id") == relationship_id) if relationship_id is not None else rows.where(F.col("global_id") == global_id)


def list_relationships(relationships: DataFrame, model: int, classes: tuple[str, ...] = (), limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of relationships by name, nulls last, then id."""
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise PlanError(f"limit 1 to {MAX_LIMIT}, offset from 0")
    rows = relationships.where(F.col("source_model_id") == model)
    if classes:
        rows = rows.where(F.col("ifc_class").isin(list(classes)))
    return rows.orderBy(F.col("name").asc_nulls_last(), "id").offset(offset).limit(limit)


def hydrated(primary: DataFrame, hops: DataFrame, entities: DataFrame, model: int, cap: int = MAX_CONTEXT) -> DataFrame:
    """part (primary or context), id, global_id, ifc_class and name of a walk: the entities it was about and those met, the smallest ids of them."""
    from trellisq.operators.entities import hydrate

    known = hydrate(entities.where(F.col("source_model_id") == model)).select("id", "global_id", "ifc_class", "name")
    met = hops.select(F.col("to_id").alias("id")).union(hops.select("from_id")).distinct().join(primary.select("id"), "id", "left_anti").orderBy("id").limit(cap)
    first = known.join(primary.select("id").distinct(), "id", "left_semi").withColumn("part", F.lit("primary"))
    return first.unionByName(known.join(met, "id", "left_semi").withColumn("part", F.lit("context"))).select("part", "id", "global_id", "ifc_class", "name")


def retained(hops: DataFrame, seeds: DataFrame, accepted: DataFrame, cap: int = MAX_TOPOLOGY_HOPS) -> tuple[DataFrame, bool]:
    """(hops whose ends both are seeds or accepted, whether there were too many to keep any)."""
    if hops.limit(cap + 1).count() > cap:
        return hops.where(F.lit(False)), True
    keep = seeds.select("id").union(accepted.select("id")).distinct()
    return hops.join(keep.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(keep.select(F.col("id").alias("to_id")), "to_id", "left_semi"), False


def relationship_members(members: DataFrame, relationship_id: int, relationships: DataFrame | None = None) -> DataFrame:
    """The members in order; with the relationships given, a missing one is an error."""
    if relationships is not None and not relationships.where(F.col("id") == relationship_id).take(1):
        raise PlanError(f"no relationship {relationship_id}")
    return members.where(F.col("relationship_id") == relationship_id).orderBy("role", F.col("member_order").asc_nulls_last(), "id")


def expand_relationships(relationship_ids: DataFrame, members: DataFrame, entities: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(resolved entities, unresolved members) of relationships (one column, id)."""
    m = members.join(relationship_ids.select(F.col("id").alias("relationship_id")), "relationship_id", "left_semi")
    known = entities.select(F.col("id").alias("entity_id"), "global_id", "ifc_class")
    found = m.join(known, "entity_id").select("entity_id", "global_id", "ifc_class").distinct().orderBy("entity_id").limit(limit)
    return found, m.join(known.select("entity_id"), "entity_id", "left_anti").select("id", "relationship_id", "role", "endpoint_global_id")


def role_counts(members: DataFrame, relationships: DataFrame) -> DataFrame:
    """Endpoints of each relationship class, role and class, and how many of them are resolved."""
    r = relationships.select(F.col("id").alias("relationship_id"), F.col("ifc_class").alias("rel_class"))
    return members.join(r, "relationship_id").groupBy("rel_class", "role", "endpoint_ifc_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("entity_id").isNotNull()).alias("n_resolved"))
