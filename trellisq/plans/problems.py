"""The pN_ queries of the general problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.operators import hierarchy, pivot, units
from trellisq.operators.orphans import orphan_counts, orphan_references
from trellisq.operators.shred import flat_table, shred_table
from trellisq.sources import table


def _stated(spark: SparkSession, d: str) -> DataFrame:
    return units.statements(table(spark, d, "ifc_entities"), table(spark, d, "ifc_source_models"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.contradictions(units.convert_units(_stated(spark, d)))


def p1_converted(spark: SparkSession, d: str) -> DataFrame:
    """Every value of known unit in m, m² or m³."""
    return _stated(spark, d).where("si_value is not null").drop("measure_type")


def p1_decisions(spark: SparkSession, d: str) -> DataFrame:
    """How many statements of each section have a declared, a predicted and no certain unit."""
    return units.convert_units(_stated(spark, d)).groupBy("section", "decision").agg(F.count(F.lit(1)).alias("n"))


def p1_predicted(spark: SparkSession, d: str) -> DataFrame:
    """Values without known unit: the predicted unit with its probability, converted or routed for review."""
    return units.predict_units(_stated(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy_links(table(spark, d, "relationship_members"), table(spark, d, "ifc_relationships"), table(spark, d, "ifc_entities"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.on_or_below_loops(_links(spark, d))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.full_hierarchy(_links(spark, d), table(spark, d, "ifc_entities"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.all_descendants(_links(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    both = [shred_table(table(spark, d, t), t, columns=False) for t in ("ifc_entities", "ifc_relationships")]
    return both[0].unionByName(both[1]).where("in_array and is_object").select("source_table", "record_id", F.col("node_id").alias("json_path"))


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """The related flat tables of both JSON columns in long form, with their foreign keys."""
    both = [shred_table(table(spark, d, t), t) for t in ("ifc_entities", "ifc_relationships")]
    return both[0].unionByName(both[1]).withColumn("columns", F.to_json("columns"))


def _flat(spark: SparkSession, d: str, name: str, columns: dict[str, str]) -> DataFrame:
    return flat_table(shred_table(table(spark, d, "ifc_entities"), "ifc_entities"), name, columns)


def p3_properties(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the fields of all property sets, with the key of the set that each belongs to."""
    return _flat(spark, d, "property_sets{}{}", {"key": "string", "value": "string", "type": "string", "measure_type": "string", "unit_override_key": "string"}).drop("ordinal")


def p3_materials(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of materials, with the place of each in its array."""
    return _flat(spark, d, "materials", {"name": "string"})


def _wide(spark: SparkSession, d: str) -> DataFrame:
    catalog = pivot.catalog_rows(table(spark, d, "attribute_catalog"))
    return pivot.pivot(pivot.statements(table(spark, d, "ifc_entities"), catalog), catalog)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).select("entity_id", F.explode("unsettled").alias("attribute"))


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).withColumn("unsettled", F.concat_ws(",", "unsettled"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "relationship_members"), table(spark, d, "ifc_relationships"), table(spark, d, "ifc_entities")).select("member_id", "ref_field", "state")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(orphan_references(table(spark, d, "relationship_members"), table(spark, d, "ifc_relationships"), table(spark, d, "ifc_entities")))


_P6 = """
with refs as (
  select id as member_id, 'entity_id' as ref_field, relationship_id, source_model_id, cast(entity_id as varchar) as k
  from relationship_members where entity_id is not null
  union all
  select id, 'endpoint_global_id', relationship_id, source_model_id, endpoint_global_id
  from relationship_members where endpoint_global_id is not null
  union all
  select id, 'endpoint_step_id', relationship_id, source_model_id, cast(endpoint_step_id as varchar)
  from relationship_members where endpoint_global_id is not null and endpoint_step_id is not null
), parents as (
  select 'entity_id' as ref_field, source_model_id, cast(id as varchar) as k, import_timestamp from ifc_entities
  union all select 'endpoint_global_id', source_model_id, global_id, import_timestamp from ifc_entities
  union all select 'endpoint_step_id', source_model_id, cast(step_id as varchar), import_timestamp from ifc_entities
), firsts as (
  select ref_field, source_model_id, k, min(import_timestamp) as first_parent, count(*) as n
  from parents where k is not null and source_model_id is not null group by 1, 2, 3
), judged as (
  select r.member_id, r.ref_field, x.import_timestamp as rel_ts,
    case when f.n is null then 'missing' when f.first_parent > x.import_timestamp then 'late' end as state
  from refs r
  left join firsts f on f.ref_field = r.ref_field and f.source_model_id = r.source_model_id and f.k = r.k
  left join ifc_relationships x on x.id = r.relationship_id
)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_converted": p1_converted,
    "p1_predicted": p1_predicted,
    "p1_decisions": p1_decisions,
    "p2_found": p2_found,
    "p2_paths": p2_paths,
    "p2_descendants": p2_descendants,
    "p3_found": p3_found,
    "p3_tables": p3_tables,
    "p3_properties": p3_properties,
    "p3_materials": p3_materials,
    "p5_found": p5_found,
    "p5_wide": p5_wide,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
}

_LINKS = """
with recursive m as (
  select distinct x.relationship_id as r, x.entity_id as e, case when lower(x.role) like 'relating%' then 1 when lower(x.role) like 'related%' then 0 end as owner
  from relationship_members x join ifc_relationships y on y.id = x.relationship_id
  where lower(y.ifc_class) in ('ifcrelaggregates', 'ifcrelnests', 'ifcrelcontainedinspatialstructure') and x.entity_id in (select id from ifc_entities)
), links as (
  select distinct b.e as child, a.e as parent from m a join m b on a.r = b.r where a.owner = 1 and b.owner = 0
), above as (
  select child, parent from links union select a.child, l.parent from above a join links l on l.child = a.parent
)"""

_ON_LOOP = """, on_loop as (
  select a.child as e, min(b.child) as loop_id from above a join above b on b.child = a.parent and b.parent = a.child group by 1
)"""

_NODES = """with recursive src as (
  select 'ifc_entities' as source_table, id, canonical_json as j from ifc_entities where id is not null and json_valid(canonical_json)
  union all select 'ifc_relationships', id, canonical_json from ifc_relationships where id is not null and json_valid(canonical_json)
), node as (
  select source_table, id, '' as path, cast(j as json) as v, false as element from src
  union all
  select n.source_table, n.id, case when json_type(n.v) = 'ARRAY' then n.path || '[' || c.key || ']' when n.path = '' then c.key else n.path || '.' || c.key end,
    case when c.type = 'VARCHAR' and ltrim(c.value ->> '$', chr(32) || chr(9) || chr(10) || chr(13))[1] in ('[', '{') and json_valid(c.value ->> '$') then cast(c.value ->> '$' as json) else c.value end,
    json_type(n.v) = 'ARRAY'
  from node n, json_each(n.v) c where json_type(n.v) in ('ARRAY', 'OBJECT') and (c.type in ('ARRAY', 'OBJECT') or (c.type = 'VARCHAR' and ltrim(c.value ->> '$', chr(32) || chr(9) || chr(10) || chr(13))[1] in ('[', '{')))
)
"""
_READ = r"""
with c as (
  select distinct lower(trim(ifc_class)) as cls, attribute, data_type, lower(regexp_replace(attribute, '[\s_]', '', 'g')) as k from attribute_catalog
), s as (
  select id, lower(trim(ifc_class)) as cls, sn, json_extract(canonical_json, '$.property_sets."' || sn || '"') as o from (select id, ifc_class, canonical_json, unnest(json_keys(canonical_json, '$.property_sets')) as sn from ifc_entities where id is not null)
), f as (
  select id, cls, lower(regexp_replace(fn, '[\s_]', '', 'g')) as k, json_extract(o, '$."' || fn || '".value') as j from (select id, cls, o, unnest(json_keys(o)) as fn from s where json_type(o) = 'OBJECT')
), v as (
  select f.id, attribute, data_type, json_type(j) as jt, trim(j ->> '$', chr(32) || chr(9) || chr(10) || chr(13)) as t
  from f join c using (cls, k) where json_type(j) <> 'NULL' and trim(j ->> '$', chr(32) || chr(9) || chr(10) || chr(13)) <> ''
), d as (
  select *, case when jt in ('ARRAY', 'OBJECT') and data_type <> 'string' then null
    when data_type = 'string' then lower(t)
    when data_type = 'boolean' then case when lower(t) in ('true', 't', '.t.', '.true.', 'yes', 'y', '1', '1.0', 'ja', 'j', 'wahr', 'oui', 'o', 'vrai') then 'true' when lower(t) in ('false', 'f', '.f.', '.false.', 'no', 'n', '0', '0.0', 'nein', 'falsch', 'non', 'faux') then 'false' end
    when jt = 'BOOLEAN' then null
    when data_type in ('int', 'double') then case when regexp_full_match(t, '[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?') then
      case when data_type = 'double' then cast(try_cast(replace(t, ',', '.') as double) as varchar) when try_cast(replace(t, ',', '.') as double) = floor(try_cast(replace(t, ',', '.') as double)) then cast(try_cast(replace(t, ',', '.') as double) as varchar) end end
    when data_type = 'date' then cast(case
      when regexp_full_match(t, '\d{4}[-/.]\d{1,2}[-/.]\d{1,2}([T ].*)?') then try_cast(regexp_replace(t, '^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2}).*$', '\1-\2-\3') as date)
      when regexp_full_match(t, '\d{1,2}\.\d{1,2}\.\d{4}([T ].*)?') then try_cast(regexp_replace(t, '^(\d{1,2})\.(\d{1,2})\.(\d{4}).*$', '\3-\2-\1') as date)
      when regexp_full_match(t, '\d{1,2}/\d{1,2}/\d{4}([T ].*)?') then case
        when try_cast(regexp_replace(t, '^(\d{1,2})/(\d{1,2})/(\d{4}).*$', '\3-\2-\1') as date) is null then try_cast(regexp_replace(t, '^(\d{1,2})/(\d{1,2})/(\d{4}).*$', '\3-\1-\2') as date)
        when try_cast(regexp_replace(t, '^(\d{1,2})/(\d{1,2})/(\d{4}).*$', '\3-\1-\2') as date) is null or split_part(t, '/', 1) = split_part(t, '/', 2) then try_cast(regexp_replace(t, '^(\d{1,2})/(\d{1,2})/(\d{4}).*$', '\3-\2-\1') as date) end
      when regexp_full_match(t, '\d{8}') then try_cast(substr(t, 1, 4) || '-' || substr(t, 5, 2) || '-' || substr(t, 7) as date) end as varchar) end as canon
  from v
)
"""

ORACLES = {
    "p5_found": _READ + "select id as entity_id, attribute from d group by 1, 2 having bool_or(canon is null) or count(distinct canon) > 1",
    "p3_found": _NODES + "select source_table, id as record_id, path as json_path from node where element and json_type(v) = 'OBJECT'",
    "p3_materials": _NODES + """select id as record_id, path as node_id, '' as parent_node_id, cast(regexp_extract(path, '\\[(\\d+)\\]$', 1) as int) as ordinal, v ->> '$.name' as name
from node where source_table = 'ifc_entities' and regexp_full_match(path, 'materials\\[\\d+\\]') and json_type(v) = 'OBJECT'""",
    "p3_properties": """with s as (
  select id, k, json_extract(canonical_json, '$.property_sets."' || k || '"') as v from (select id, canonical_json, unnest(json_keys(canonical_json, '$.property_sets')) as k from ifc_entities)
), f as (
  select id, k, f, json_extract(v, '$."' || f || '"') as v from (select id, k, v, unnest(json_keys(v)) as f from s where json_type(v) = 'OBJECT')
) select id as record_id, 'property_sets.' || k || '.' || f as node_id, 'property_sets.' || k as parent_node_id, f as key, case when json_type(v, '$.value') not in ('ARRAY', 'OBJECT') then v ->> '$.value' end as value, v ->> '$.type' as type, v ->> '$.measure_type' as measure_type, v ->> '$.unit_override_key' as unit_override_key
from f where json_type(v) = 'OBJECT'""",
    # No two entities of the test data are 64 links apart.
    "p2_descendants": _LINKS + """, down as (
  select parent as a, child as v, 1 as lev from links where parent <> child
  union select d.a, l.child, d.lev + 1 from down d join links l on l.parent = d.v where l.child <> d.a and d.lev < 64
) select a as entity_id, v as descendant_id, min(lev) as levels from down group by 1, 2""",
    # Entries and exits follow from the order of the paths where each relationship has one owner, as in the test data.
    "p2_paths": _LINKS + _ON_LOOP + """, tp as (
  select l.child, min(l.parent) as parent, count(distinct l.parent) as n_parents from links l left join on_loop c on c.e = l.child left join on_loop q on q.e = l.parent
  where c.e is null or (c.e <> c.loop_id and q.loop_id = c.loop_id) group by 1
), walk as (
  select id as v, [id] as path from (select distinct id from ifc_entities where id is not null) where id not in (select child from tp)
  union all select t.child, list_append(w.path, t.child) from walk w join tp t on t.parent = w.v
), pre as (
  select v, path, row_number() over (partition by path[1] order by path) - 1 as "at" from walk
), size as (
  select a, count(*) as n from (select unnest(path) as a from walk) group by 1
), many as (
  select a, count(*) as n from (select distinct x.parent as a, x.child from above x where x.parent <> x.child) group by 1
) select p.v as entity_id, p.path[-2] as parent_id, p.path[1] as root_id, len(p.path) - 1 as depth, p.path, 2 * p."at" - (len(p.path) - 1) as entry, 2 * p."at" - (len(p.path) - 1) + 2 * z.n - 1 as exit,
  coalesce(m.n, 0) as n_descendants, coalesce(t.n_parents, 0) as n_parents, o.loop_id
from pre p join size z on z.a = p.v left join many m on m.a = p.v left join tp t on t.child = p.v left join on_loop o on o.e = p.v""",
    "p2_found": _LINKS + _ON_LOOP + """ select distinct x.e as entity_id, o.loop_id from (select child as e, parent as a from above union select e, e from on_loop) x join on_loop o on o.e = x.a""",
    "p6_found": _P6 + "select member_id, ref_field, state from judged where state is not null",
    "p6_counts": _P6 + "select ref_field, state, strftime(rel_ts, '%Y-%m') as month, count(*) as n from judged where state is not null group by 1, 2, 3",
}
