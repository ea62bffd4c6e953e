"""Queries of graph, vector, spatial, profile and document operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellisq.functions.lexical import natural_key
from trellisq.operators import candidates as K
from trellisq.operators import documents as D
from trellisq.operators import fields as FL
from trellisq.operators import graph as G
from trellisq.operators import profile as P
from trellisq.operators import spatial as S
from trellisq.operators import vectors as V
from trellisq.runtime import Scratch
from trellisq.sources import ingest, table
from trellisq.streaming import incremental

MODEL = 17
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


# --- graph
_REG = ", ".join(f"('{c}', '{a.lower()}', '{b.lower()}', '{way}')" for c, _, rel, red in G.REGISTRY for way, xs, ys in (("outgoing", rel, red), ("incoming", red, rel)) for a in xs for b in ys)
_STEP = f"""
select distinct r.id as relationship_id, r.ifc_class as rel_class, g.way as direction, f.entity_id as from_id, f.role as from_role, t.entity_id as to_id, t.role as to_role
from relationship_members f join ifc_relationships r on r.id = f.relationship_id and r.source_model_id = {MODEL}
join (values {_REG}) g(cls, a, b, way) on g.cls = r.ifc_class and g.a = lower(f.role)
join relationship_members t on t.relationship_id = r.id and lower(t.role) = g.b and t.id <> f.id and t.entity_id <> f.entity_id and t.source_model_id = {MODEL}
where f.source_model_id = {MODEL}"""
_SEEDS = f"select id from ifc_entities where source_model_id = {MODEL} and ifc_class = 'IfcBuildingStorey' order by id limit 50"


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return G.seeds_of(_t(s, d, "ifc_entities").where(f"source_model_id = {MODEL} and ifc_class = 'IfcBuildingStorey'"))


def _walk(s: SparkSession, d: str, depth: int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    seeds = _seeds(s, d)
    return G.traverse(seeds, _t(s, d, "relationship_members"), _t(s, d, "ifc_relationships"), MODEL, depth, direction=direction)[0], seeds


def _hops(depth: int, extra: str = "") -> str:
    parts = [f"with step as ({_STEP}{extra}), seeds as ({_SEEDS}), h1 as (select 1 as depth, s.* from step s where from_id in (select id from seeds))"]
    for k in range(2, depth + 1):
        seen = " union all ".join(["select id from seeds", *(f"select to_id from h{j}" for j in range(1, k - 1))])
        parts.append(f"h{k} as (select {k} as depth, s.* from step s where from_id in (select to_id from h{k - 1}) and from_id not in ({seen}))")
    union = " union all ".join(f"select * from h{k}" for k in range(1, depth + 1))
    return ", ".join(parts) + f", hops as ({union})"


for _way in ("outgoing", "incoming"):
    _add(f"graph_expand_{_way}", lambda s, d, w=_way: _walk(s, d, 1, w)[0].drop("semantic_role"), _hops(1, f" and g.way = '{_way}'") + " select * from hops")
for _k in (2, 3):
    _add(f"graph_traverse_d{_k}", lambda s, d, k=_k: _walk(s, d, k)[0].drop("semantic_role"), _hops(_k) + " select * from hops")


def _reached(s: SparkSession, d: str) -> DataFrame:
    hops, seeds = _walk(s, d, 2)
    return G.endpoints(hops, seeds, _t(s, d, "ifc_entities"), ("IfcWall", "IfcDoor"))


_add(
    "graph_seeded_endpoint_filter",
    _reached,
    _hops(2) + " select e.id, e.global_id, e.ifc_class, min(h.depth) as depth from hops h join ifc_entities e on e.id = h.to_id where e.id not in (select id from seeds) and e.ifc_class in ('IfcWall', 'IfcDoor') group by 1, 2, 3",
)


def _connections(s: SparkSession, d: str) -> DataFrame:
    return G.connections(_walk(s, d, 2)[0]).groupBy("rel_class").agg(F.count(F.lit(1)).alias("n"))


_add(
    "graph_connections",
    _connections,
    _hops(2) + " select rel_class, count(*) as n from (select distinct relationship_id, rel_class, case when direction = 'outgoing' then from_id else to_id end, case when direction = 'outgoing' then from_role else to_role end, case when direction = 'outgoing' then to_id else from_id end, case when direction = 'outgoing' then to_role else from_role end from hops) group by 1",
)
def _topology(s: SparkSession, d: str, which: int) -> DataFrame:
    hops, seeds = _walk(s, d, 2)
    return G.topology(hops, seeds, _t(s, d, "ifc_entities"))[which]


_KEYED = """, firsts as (
  select id, rel_class, role from (
    select to_id as id, rel_class, to_role as role, row_number() over (partition by to_id order by depth, rel_class, to_role) as rn
    from hops where to_id not in (select id from seeds)) where rn = 1
), keyed as (
  select e.id, e.ifc_class || '|' || f.rel_class || '|' || f.role as node from firsts f join ifc_entities e on e.id = f.id
  union all select id, 'SEED' from seeds
)"""
_add("graph_topology_nodes", lambda s, d: _topology(s, d, 0).select("node", "n_entities"), _hops(2) + _KEYED + " select node, count(distinct id) as n_entities from keyed group by 1")
_add(
    "graph_topology_edges",
    lambda s, d: _topology(s, d, 1).drop("edge_id"),
    _hops(2) + _KEYED + """, conn as (
  select distinct relationship_id, rel_class, case when direction = 'outgoing' then from_id else to_id end as src, case when direction = 'outgoing' then to_id else from_id end as dst from hops
) select a.node as source, b.node as target, rel_class, count(*) as n_connections from conn join keyed a on a.id = src join keyed b on b.id = dst group by 1, 2, 3""",
)
_add(
    "endpoint_role_counts",
    lambda s, d: G.role_counts(_t(s, d, "relationship_members"), _t(s, d, "ifc_relationships")),
    "select r.ifc_class as rel_class, m.role, m.endpoint_ifc_class, count(*) as n, count(*) filter (where m.entity_id is not null) as n_resolved from relationship_members m join ifc_relationships r on r.id = m.relationship_id group by 1, 2, 3",
)
_add("rel_members", lambda s, d: G.relationship_members(_t(s, d, "relationship_members"), 501).select("id", "role", "member_order", "entity_id"), "select id, role, member_order, entity_id from relationship_members where relationship_id = 501")
_add(
    "rel_list",
    lambda s, d: _t(s, d, "ifc_relationships").where(f"source_model_id = {MODEL} and ifc_class = 'IfcRelAggregates'").orderBy(F.col("name").asc_nulls_last(), "id").limit(50).select("id", "global_id", "name"),
    f"select id, global_id, name from ifc_relationships where source_model_id = {MODEL} and ifc_class = 'IfcRelAggregates' order by name nulls last, id limit 50",
)


_add(
    "unresolved_endpoints_all",
    lambda s, d: G.expand_relationships(_t(s, d, "ifc_relationships").select("id"), _t(s, d, "relationship_members"), _t(s, d, "ifc_entities"))[1],
    "select m.id, m.relationship_id, m.role, m.endpoint_global_id from relationship_members m where m.relationship_id in (select id from ifc_relationships) and not exists (select 1 from ifc_entities e where e.id = m.entity_id)",
)

_add("unresolved_endpoints", QUERIES["unresolved_endpoints_all"], ORACLES["unresolved_endpoints_all"])

# --- sets of ids
_RELATED = "select distinct entity_id from relationship_members where entity_id is not null"


def _in_members(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "relationship_members").where("entity_id is not null").select(F.col("entity_id").alias("id")).distinct()


_add("scope_semi", lambda s, d: _t(s, d, "ifc_entities").join(_in_members(s, d), "id", "left_semi").groupBy("ifc_class").agg(F.count(F.lit(1)).alias("n")), f"select ifc_class, count(*) as n from ifc_entities where id in ({_RELATED}) group by 1")
_add("scope_anti", lambda s, d: _t(s, d, "ifc_entities").join(_in_members(s, d), "id", "left_anti").groupBy("ifc_class").agg(F.count(F.lit(1)).alias("n")), f"select ifc_class, count(*) as n from ifc_entities where id not in ({_RELATED}) group by 1")
_add(
    "set_union",
    lambda s, d: _t(s, d, "ifc_entities").select("global_id").union(_t(s, d, "ifc_relationships").select("global_id")).distinct().agg(F.count(F.lit(1)).alias("n")),
    "select count(*) as n from (select global_id from ifc_entities union select global_id from ifc_relationships)",
)
_add(
    "set_difference",
    lambda s, d: _t(s, d, "relationship_members").select("endpoint_global_id").subtract(_t(s, d, "ifc_entities").select("global_id")).agg(F.count(F.lit(1)).alias("n")),
    "select count(*) as n from (select endpoint_global_id from relationship_members except select global_id from ifc_entities)",
)

# --- vectors
_Q = "(select embedding from embeddings where vec_id = 0)"


def _query_vector(s: SparkSession, d: str) -> list[float]:
    return list(_t(s, d, "embeddings").where("vec_id = 0").first().embedding)


def _vec(s: SparkSession, d: str, k: int = 10, threshold: float | None = None, scope: DataFrame | None = None) -> DataFrame:
    return V.search(_t(s, d, "embeddings").withColumnRenamed("vec_id", "id"), _query_vector(s, d), k, threshold, scope).withColumn("similarity", F.round("similarity", 4))


_COS = f"round(list_cosine_similarity(embedding, {_Q}), 4)"
_RANKED = "select vec_id as id, {c} as similarity, cast(row_number() over (order by list_cosine_similarity(embedding, {q}) desc, vec_id) as int) as rank from embeddings {w} qualify rank <= {k}"
_add("vec_topk_cosine", lambda s, d: _vec(s, d).drop("accepted"), _RANKED.format(c=_COS, q=_Q, w="", k=10))
_add(
    "vec_topk_scoped",
    lambda s, d: _vec(s, d, scope=_t(s, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))).drop("accepted"),
    _RANKED.format(c=_COS, q=_Q, w="where label = 3", k=10),
)
_add("vec_threshold", lambda s, d: _vec(s, d, 50, 0.25).where("accepted").drop("accepted", "rank"), f"select vec_id as id, {_COS} as similarity from embeddings where list_cosine_similarity(embedding, {_Q}) >= 0.25 order by list_cosine_similarity(embedding, {_Q}) desc, vec_id limit 50")
_add("vec_empty_scope", lambda s, d: _vec(s, d, scope=_t(s, d, "embeddings").where("label < 0").select(F.col("vec_id").alias("id"))).drop("accepted"), _RANKED.format(c=_COS, q=_Q, w="where false", k=10))
_add(
    "vec_invalid",
    lambda s, d: V.invalid_vectors(_t(s, d, "rag_documents"), 1024).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    "select case when embedding is null then 'null' when len(embedding) <> 1024 then 'length' else 'zero' end as reason, count(*) as n from rag_documents where embedding is null or len(embedding) <> 1024 or list_max(list_transform(embedding, lambda x: abs(x))) = 0 group by 1",
)


def _fused(s: SparkSession, d: str) -> DataFrame:
    of = lambda low, high: _vec(s, d, 20, scope=_t(s, d, "embeddings").where(f"label between {low} and {high}").select(F.col("vec_id").alias("id")))
    return V.fuse({"entity": of(0, 4), "relationship": of(3, 9)}).withColumn("score", F.round("score", 6)).drop("best_rank")


_LIST = "select '{k}' as kind, vec_id as id, row_number() over (order by list_cosine_similarity(embedding, {q}) desc, vec_id) as rank from embeddings where label between {a} and {b} qualify rank <= 20"
_add("rrf_fusion", _fused, f"select kind, id, round(sum(1.0 / (60 + rank)), 6) as score from (({_LIST.format(k='entity', q=_Q, a=0, b=4)}) union all ({_LIST.format(k='relationship', q=_Q, a=3, b=9)})) group by 1, 2")


def _precision(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "embeddings")
    found = _vec(s, d, 20).agg(F.collect_list("id").alias("found"))
    label = e.where("vec_id = 0").select("label")
    relevant = e.join(label, "label").agg(F.collect_list("vec_id").alias("relevant"))
    p, r = V.precision_recall(F.col("found"), F.col("relevant"))
    return found.crossJoin(relevant).select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))  # one row each


_add(
    "precision_recall",
    _precision,
    f"with f as ({_RANKED.format(c=_COS, q=_Q, w='', k=20)}), r as (select vec_id from embeddings where label = (select label from embeddings where vec_id = 0)), h as (select count(*) as n from f where id in (select vec_id from r)) select round(n / (select count(*) from f), 6) as precision, round(n / (select count(*) from r), 6) as recall from h",
)

# --- levels
_LEVELS = """
with l as (
  select source_model_id, id, global_id, coalesce(try_cast(json_extract_string(canonical_json, '$.placement.elevation') as double), try_cast(json_extract_string(canonical_json, '$.placement.local_z') as double)) as elevation
  from ifc_entities where lower(ifc_class) = 'ifcbuildingstorey'
), g as (
  select *, elevation - lag(elevation) over (partition by source_model_id order by elevation, global_id) as gap from l where elevation is not null
), x as (
  select *, max(case when gap > eps then gap end) over (partition by source_model_id) as largest
  from (select *, greatest(max(elevation) over (partition by source_model_id) - min(elevation) over (partition by source_model_id), 1.0) * 1e-9 as eps from g)
), b as (
  select source_model_id, id, elevation, cast(sum(case when coalesce(gap > 0.3 * largest, false) then 1 else 0 end) over (partition by source_model_id order by elevation, global_id rows unbounded preceding) as bigint) as band from x
)"""


def _bands(s: SparkSession, d: str) -> DataFrame:
    return S.bands(S.storeys(_t(s, d, "ifc_entities")))


_add("spatial_gap_bands", lambda s, d: _bands(s, d).select("source_model_id", "id", "elevation", "band"), _LEVELS + " select * from b")
_SUMMARY = _LEVELS + """, s as (select source_model_id, band, min(elevation) as low, max(elevation) as high, count(*) as n_storeys from b group by 1, 2),
r as (select *, (max(high) over (partition by source_model_id) - min(low) over (partition by source_model_id)) * 0.01 as slack from s),
z as (select *, coalesce(min(case when low - slack <= 0 and high + slack >= 0 then band end) over (partition by source_model_id), min(band) over (partition by source_model_id)) as reference from r)"""
_add(
    "spatial_reference_band",
    lambda s, d: S.band_summary(_bands(s, d)),
    _SUMMARY + " select source_model_id, band, low, high, n_storeys, reference, case when band >= reference then 'Floor ' || (band - reference + 1) else 'Lower level ' || (reference - band) end as label from z",
)
_add(
    "spatial_floor_concept",
    lambda s, d: S.floor_bands(S.band_summary(_bands(s, d)), S.resolve_floor("the second floor")).select("source_model_id", "band", "low"),
    _SUMMARY + " select source_model_id, band, low from z where band = reference + 1",
)
_add(
    "spatial_plan_range",
    lambda s, d: S.cut_ranges(S.band_summary(_bands(s, d))).select("source_model_id", "band", F.round("plan_top", 4).alias("plan_top"), F.round("plan_bottom", 4).alias("plan_bottom")),
    _SUMMARY + " select source_model_id, band, round(least(low + 1.2, coalesce(lead(low) over w, low + 1.2)), 4) as plan_top, round(coalesce((lag(high) over w + low) / 2, low), 4) as plan_bottom from z window w as (partition by source_model_id order by band)",
)

# --- profiles
_SET_FIELDS = """
with sets as (
  select source_model_id, id, ifc_class, sec as section, unnest(json_keys(canonical_json, '$.' || sec)) as set_name, canonical_json
  from ifc_entities, (values ('property_sets'), ('quantity_sets')) v(sec)
), flds as (
  select source_model_id, id as entity_id, ifc_class, section, set_name, unnest(json_keys(canonical_json, '$.' || section || '."' || set_name || '"')) as field_name, canonical_json from sets
), f as (
  select source_model_id, entity_id, ifc_class, section, set_name, field_name,
    json_extract_string(canonical_json, '$.' || section || '."' || set_name || '"."' || field_name || '".value') as value,
    json_type(canonical_json, '$.' || section || '."' || set_name || '"."' || field_name || '".value') as kind,
    json_extract_string(canonical_json, '$.' || section || '."' || set_name || '"."' || field_name || '".measure_type') as measure_type,
    json_extract_string(canonical_json, '$.' || section || '."' || set_name || '"."' || field_name || '".unit_override_key') as unit_override_key
  from flds
)"""


#: The same with the measurements, which lie in no set.
_ALL_FIELDS = _SET_FIELDS.replace("\n), f as (", "\n), in_sets as (") + """, flat as (
  select source_model_id, id as entity_id, ifc_class, 'measurements' as section, cast(null as varchar) as set_name, unnest(json_keys(canonical_json, '$.measurements')) as field_name, canonical_json from ifc_entities
), f as (
  select * from in_sets union all
  select source_model_id, entity_id, ifc_class, section, set_name, field_name,
    json_extract_string(canonical_json, '$.measurements."' || field_name || '".value'), json_type(canonical_json, '$.measurements."' || field_name || '".value'),
    json_extract_string(canonical_json, '$.measurements."' || field_name || '".measure_type'), json_extract_string(canonical_json, '$.measurements."' || field_name || '".unit_override_key')
  from flat
)"""


_FIELDS = _ALL_FIELDS


def _all_fields(s: SparkSession, d: str) -> DataFrame:
    return FL.entity_fields(_t(s, d, "ifc_entities"))


_fields = _all_fields


def _schema(s: SparkSession, d: str) -> DataFrame:
    """Sets and fields of all sections, and the classes of entities and relationships as sections of their own."""
    none = F.lit(None).cast("string").alias("set_name")
    of = lambda t, section: _t(s, d, t).groupBy("source_model_id", F.lit(section).alias("section"), none, F.col("ifc_class").alias("field_name")).agg(F.countDistinct("id").alias("n_entities"), F.countDistinct("ifc_class").alias("n_classes"))
    return FL.schema_catalog(_all_fields(s, d), None).unionByName(of("ifc_entities", "entity_classes")).unionByName(of("ifc_relationships", "relationship_classes"))


_add(
    "schema_catalog_all",
    _schema,
    _ALL_FIELDS + """ select source_model_id, section, set_name, field_name, count(distinct entity_id) as n_entities, count(distinct ifc_class) as n_classes from f group by 1, 2, 3, 4
union all select source_model_id, 'entity_classes', null, ifc_class, count(distinct id), count(distinct ifc_class) from ifc_entities group by 1, 4
union all select source_model_id, 'relationship_classes', null, ifc_class, count(distinct id), count(distinct ifc_class) from ifc_relationships group by 1, 4""",
)
_add("schema_catalog", QUERIES["schema_catalog_all"], ORACLES["schema_catalog_all"])
_add(
    "profile_class_counts",
    lambda s, d: P.class_counts(_t(s, d, "ifc_entities")),
    "select source_model_id, ifc_class, count(*) as n from ifc_entities group by 1, 2",
)
_add(
    "profile_topk_values_per_class",
    lambda s, d: P.top_per(_t(s, d, "ifc_entities").select("ifc_class", F.get_json_object("canonical_json", "$.storey.name").alias("storey")).where("storey is not null"), ["ifc_class"], "storey", 5).select("ifc_class", "storey", "n"),
    "select ifc_class, storey, n from (select ifc_class, storey, count(*) as n, row_number() over (partition by ifc_class order by count(*) desc, storey) as nth from (select ifc_class, json_extract_string(canonical_json, '$.storey.name') as storey from ifc_entities) where storey is not null group by 1, 2) where nth <= 5",
)
_add(
    "profile_field_coverage",
    lambda s, d: P.field_coverage(_fields(s, d), _t(s, d, "ifc_entities")),
    _FIELDS + ", t as (select ifc_class, count(*) as n_total from ifc_entities group by 1), g as (select ifc_class, section, set_name, field_name, count(distinct case when value <> '' then entity_id end) as n_filled from f group by 1, 2, 3, 4) select g.*, n_total, case when n_filled = 0 then 'absent' when n_filled >= n_total then 'populated' else 'partial' end as coverage from g join t using (ifc_class)",
)
_add(
    "profile_field_coverage_all",
    lambda s, d: P.field_coverage(_all_fields(s, d), _t(s, d, "ifc_entities")),
    _ALL_FIELDS + ORACLES["profile_field_coverage"].removeprefix(_FIELDS),
)
_add(
    "profile_value_facts",
    lambda s, d: P.value_facts(_fields(s, d)).select("ifc_class", "field_name", "value", "n"),
    _FIELDS + ", n as (select ifc_class, field_name, value, count(*) as n from f where section = 'property_sets' and kind = 'VARCHAR' and length(value) between 2 and 40 group by 1, 2, 3 having count(*) >= 2), few as (select ifc_class, field_name from n group by 1, 2 having count(*) <= 15) select ifc_class, field_name, value, n from (select n.*, row_number() over (partition by ifc_class, field_name order by n desc, value) as nth from n join few using (ifc_class, field_name)) where nth <= 8",
)
_add(
    "container_shape_verdict",
    lambda s, d: P.container_shapes(_fields(s, d)).withColumn("schema_ratio", F.round("schema_ratio", 4)),
    _FIELDS + ", g as (select section, set_name, count(distinct field_name) as n_fields, count(distinct entity_id) as n_entities, count(*) as n_instances from f where set_name is not null group by 1, 2) select *, round(n_fields / (n_instances / n_entities), 4) as schema_ratio, not (n_fields >= 64 and n_fields / (n_instances / n_entities) >= 8) as reliable from g",
)


def _measures(s: SparkSession, d: str, fields=_fields) -> DataFrame:
    defaults, symbols = P.unit_tables(_t(s, d, "ifc_source_models"))
    return P.measure_facts(fields(s, d), defaults, symbols)


_add(
    "measure_facts_ladder",
    _measures,
    _FIELDS + """, m as (select id, json_extract(extraction_metadata, '$.dimension_units') as u from ifc_source_models),
dk as (select id, unnest(json_keys(u, '$.defaults')) as measure_type, u from m),
def as (select id as source_model_id, measure_type, json_extract_string(u, '$.defaults.' || measure_type) as default_key from dk),
sk as (select id, unnest(json_keys(u, '$.definitions')) as unit_key, u from m),
sym as (select id as source_model_id, unit_key, json_extract_string(u, '$.definitions."' || unit_key || '".symbol') as symbol from sk where coalesce(json_extract_string(u, '$.definitions."' || unit_key || '".resolved'), 'true') = 'true'),
e as (select f.*, coalesce(unit_override_key, default_key) as unit_key from f left join def using (source_model_id, measure_type) where value <> ''),
e2 as (select e.*, symbol from e left join sym using (source_model_id, unit_key)),
g as (select source_model_id, section, set_name, field_name, count(*) filter (where measure_type is not null) as n_typed, count(*) filter (where measure_type is null) as n_untyped,
  count(distinct measure_type) as n_measures, min(measure_type) as a_measure, count(distinct case when measure_type is not null then coalesce(unit_key, '') end) as n_units,
  min(case when measure_type is not null then coalesce(unit_key, '') end) as a_unit, min(case when measure_type is not null then symbol end) as a_symbol from e2 group by 1, 2, 3, 4),
r as (select *, case when n_typed = 0 then 'not measured' when n_measures > 1 then 'several measure types' when n_untyped > 0 then 'partly untyped' when n_units > 1 then 'several units' when a_unit = '' then 'no default unit' when a_symbol is null then 'unit not resolved' end as limitation from g)
select source_model_id, section, set_name, field_name, n_typed, n_untyped, case when n_measures = 1 then a_measure end as measure_type,
  case when limitation is null then 'uniform' when limitation = 'several units' then 'mixed' when limitation = 'not measured' then 'none' else 'unknown' end as unit_state, limitation, case when limitation is null then a_symbol end as symbol from r""",
)
_add("measure_facts_ladder_all", lambda s, d: _measures(s, d, _all_fields), _ALL_FIELDS + ORACLES["measure_facts_ladder"].removeprefix(_FIELDS))
_add(
    "profile_materials",
    lambda s, d: P.materials(_t(s, d, "ifc_entities")),
    "select ifc_class, material, count(distinct id) as n from (select id, ifc_class, json_extract_string(m, '$.name') as material from (select id, ifc_class, unnest(json_extract(json_extract_string(canonical_json, '$.materials')::json, '$[*]')) as m from ifc_entities)) where material is not null group by 1, 2",
)
_add(
    "profile_classifications",
    lambda s, d: P.classifications(_t(s, d, "ifc_entities")),
    "select system, code, count(distinct id) as n from (select id, json_extract_string(c, '$.system') as system, json_extract_string(c, '$.code') as code from (select id, unnest(json_extract(json_extract_string(canonical_json, '$.classifications')::json, '$[*]')) as c from ifc_entities)) group by 1, 2",
)
_add(
    "name_stem_groups",
    lambda s, d: _t(s, d, "ifc_relationships").groupBy(P.name_stem(F.col("name")).alias("stem")).agg(F.count(F.lit(1)).alias("n")),
    r"select regexp_replace(name, '_\(#\d+\)$', '') as stem, count(*) as n from ifc_relationships group by 1",
)
_add(
    "fair_trim_round_robin",
    lambda s, d: P.fair_trim(_t(s, d, "ifc_relationships").select("ifc_class", "id"), ["ifc_class"], [F.col("id")], 55).select("ifc_class", "id", F.col("turn").cast("long").alias("turn")),
    "select ifc_class, id, turn from (select ifc_class, id, row_number() over (partition by ifc_class order by id) as turn from ifc_relationships) order by turn, ifc_class limit 55",
)
_add(
    "nearest_rank_percentile",
    lambda s, d: P.nearest_rank(_t(s, d, "rag_documents"), "encoded_token_count", [0.5, 0.9, 0.99]),
    "with v as (select encoded_token_count as x, row_number() over (order by encoded_token_count) as rn, count(*) over () as n from rag_documents where encoded_token_count is not null) select f as fraction, x as value from v, (values (0.5::double), (0.9), (0.99)) a(f) where rn = cast(round(f * (n - 1)) as bigint) + 1",
)
_add(
    "building_profile",
    lambda s, d: P.building_profile(_t(s, d, "ifc_entities")).select("source_model_id", "kind", "value", "n"),
    """with v as (select source_model_id, 'class' as kind, ifc_class as value, 12 as cap from ifc_entities
union all select source_model_id, 'material', json_extract_string(m, '$.name'), 8 from (select source_model_id, unnest(json_extract(json_extract_string(canonical_json, '$.materials')::json, '$[*]')) as m from ifc_entities))
select source_model_id, kind, value, n from (select source_model_id, kind, value, cap, count(*) as n, row_number() over (partition by source_model_id, kind order by count(*) desc, value) as nth from v where value is not null group by 1, 2, 3, 4) where nth <= cap""",
)
_add(
    "profile_data_types",
    lambda s, d: P.data_type(_fields(s, d)),
    _FIELDS + r" select section, set_name, field_name, case when bool_and(lower(value) in ('true', 'false')) then 'boolean' when bool_and(regexp_full_match(value, '-?\d+(\.\d+)?')) then 'number' else 'text' end as data_type, count(*) as n from f where value <> '' group by 1, 2, 3",
)
_add(
    "profile_field_values",
    lambda s, d: P.field_values(_fields(s, d).where("value_kind = 'string'"), 20).select("section", "set_name", "field_name", "n_values", "access", F.concat_ws("|", "values").alias("values")),
    _FIELDS + ", g as (select section, set_name, field_name, count(distinct value) as n_values, array_to_string(list_sort(list(distinct value)), '|') as vs from f where kind = 'VARCHAR' and value <> '' group by 1, 2, 3) select section, set_name, field_name, n_values, case when n_values > 20 then 'searchable' else 'enumerated' end as access, case when n_values <= 20 then vs else '' end as values from g",
)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    items = s.createDataFrame([("L1", "walls"), ("L2", "fire rating"), ("L3", "net floor area"), ("L4", "is external")], "item_id string, text string")
    return K.score(items, K.concepts(_t(s, d, "ifc_entities"), _all_fields(s, d)))


_add("candidate_ranking", _candidates, None)

# --- documents and ingestion
_add("doc_template_text", lambda s, d: D.entity_documents(_t(s, d, "ifc_entities")), None)
_add("doc_relationship_text", lambda s, d: D.relationship_documents(_t(s, d, "ifc_relationships"), _t(s, d, "relationship_members")), None)
_add("doc_hash", lambda s, d: _t(s, d, "rag_documents").select("id", F.sha2("document_text", 256).alias("text_hash")), "select id, sha256(document_text) as text_hash from rag_documents")


_add(
    "doc_to_embed",
    lambda s, d: D.to_embed(_t(s, d, "rag_documents"), _t(s, d, "rag_documents"), 1024, ["id"]).select("id"),
    "select id from rag_documents where not coalesce(embedding is not null and len(embedding) = 1024 and source_hash is not null and text_hash is not null, false)",
)
_add(
    "ingest_member_explode",
    lambda s, d: ingest.explode_members(_t(s, d, "ifc_relationships")),
    """with k as (select id, source_model_id, canonical_json, unnest(json_keys(canonical_json, '$.endpoints')) as role from ifc_relationships),
e as (select id, source_model_id, role, json_extract(canonical_json, '$.endpoints.' || role) as v from k),
l as (select id, source_model_id, role, unnest(range(cast(json_array_length(v) as bigint))) as o, v from e where json_type(v) = 'ARRAY'),
m as (select id, source_model_id, role, cast(o as int) as member_order, json_extract(v, '$[' || o || ']') as x from l union all select id, source_model_id, role, null, v from e where json_type(v) = 'OBJECT')
select id as relationship_id, source_model_id, role, member_order, try_cast(json_extract_string(x, '$.step_id') as int) as endpoint_step_id, json_extract_string(x, '$.ifc_class') as endpoint_ifc_class, json_extract_string(x, '$.global_id') as endpoint_global_id, json_extract_string(x, '$.name') as endpoint_name from m where json_type(x) = 'OBJECT'""",
)
_add(
    "ingest_resolve_endpoints",
    lambda s, d: ingest.resolve_endpoints(_t(s, d, "relationship_members"), _t(s, d, "ifc_entities")).select("id", "entity_id"),
    "select m.id, g.entity_id from relationship_members m left join (select source_model_id, global_id, min(id) as entity_id from ifc_entities group by 1, 2) g on g.source_model_id = m.source_model_id and g.global_id = m.endpoint_global_id",
)
_add(
    "ingest_scan_report",
    lambda s, d: ingest.scan_report(_t(s, d, "ifc_entities").select("source_model_id", "global_id", "ifc_class").unionByName(_t(s, d, "ifc_relationships").select("source_model_id", "global_id", "ifc_class"))),
    """with r as (select source_model_id, global_id, ifc_class, lower(ifc_class) like 'ifcrel%' as rel, coalesce(trim(global_id) <> '', false) as has from (select source_model_id, global_id, ifc_class from ifc_entities union all select source_model_id, global_id, ifc_class from ifc_relationships)),
p as (select source_model_id, count(*) as n from (select source_model_id, global_id from r where has group by 1, 2 having count(*) > 1) group by 1)
select r.source_model_id, count(*) as n_rows, count(*) filter (where has and not rel) as n_eligible, count(*) filter (where rel) as n_relationships, count(*) filter (where not has) as n_without_id, coalesce(any_value(p.n), 0) as n_repeated_ids from r left join p using (source_model_id) group by 1""",
)
_add(
    "natural_sort_rows",
    lambda s, d: _t(s, d, "ifc_entities").select("id", F.get_json_object("canonical_json", "$.identity.name").alias("name")).withColumn("key", natural_key(F.col("name"))).orderBy(F.col("key").asc_nulls_last(), "id"),
    """select id, name, case when name is not null then array_to_string(list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'),
  lambda x: case when regexp_matches(x, '^[0-9]') then lpad(cast(length(ltrim(x, '0')) as varchar), 9, '0') || ltrim(x, '0') else lower(x) end), '') end as key
from (select id, json_extract_string(canonical_json, '$.identity.name') as name from ifc_entities) order by key nulls last, id""",
)
_add(
    "page_rows",
    lambda s, d: _t(s, d, "ifc_source_models").select("id", F.floor((F.row_number().over(Window.orderBy("id")) - 1) / 25).alias("page")),
    "select id, cast(floor((row_number() over (order by id) - 1) / 25) as bigint) as page from ifc_source_models",
)
_add(
    "event_hours",
    lambda s, d: _t(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")),
    "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2",
)


def _streamed(s: SparkSession, d: str, make) -> DataFrame:
    scratch = Scratch(s, "stream")
    return incremental.into_table(make(incremental.event_stream(s, d, "events.parquet")), f"{scratch.root}/out", f"{scratch.root}/checkpoint")


_add(
    "stream_event_hours",
    lambda s, d: _streamed(s, d, incremental.windowed_counts).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total")),
    ORACLES["event_hours"],
)
_add(
    "stream_sessions",
    lambda s, d: _streamed(s, d, incremental.sessions).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n"),
    """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from g group by user_id, k""",
)
