"""Queries of retrieval, manifests, viewer facts and assembly, each over its whole tables with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.functions.lexical import normalized
from trellisq.model import FieldKind, FieldRef
from trellisq.operators import catalog as C
from trellisq.operators import documents as D
from trellisq.operators import entities as E
from trellisq.operators import fields as FL
from trellisq.operators import graph as G
from trellisq.operators import manifest as M
from trellisq.operators import profile as P
from trellisq.operators import retrieval as R
from trellisq.operators import viewer as W
from trellisq.plans.structure import _ALL_FIELDS, _SEEDS, _all_fields, _hops, _measures, _seeds, _walk
from trellisq.sources import ingest as I
from trellisq.sources import table

MODEL = 17
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return table(s, d, name)


# --- retrieval over the stored descriptions
_ASK = f"(select {{}} from rag_documents where source_model_id = {MODEL} and source_kind = 'entity' and len(embedding) = 1024 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 order by id limit 1)"
_COSINE = f"list_cosine_similarity(embedding::double[], {_ASK.format('embedding::double[]')})"


def _kind_sql(kind: str, k: int, scope: str = "true") -> str:
    return f"""select '{kind}' as kind, {kind}_id as id, id as document_id, {_COSINE} as cos, cast(row_number() over (order by {_COSINE} desc, id) as int) as rank
from rag_documents where source_model_id = {MODEL} and source_kind = '{kind}' and embedding_model = {_ASK.format('embedding_model')} and len(embedding) = 1024 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 and {kind}_id is not null and {scope} qualify rank <= {k}"""


def _ask(s: SparkSession, d: str):
    rows = _t(s, d, "rag_documents").where(f"source_model_id = {MODEL} and source_kind = 'entity' and size(embedding) = 1024 and exists(embedding, x -> x <> 0)")
    first = rows.orderBy("id").select("embedding", "embedding_model").first()
    return list(first.embedding), first.embedding_model


def _search(s: SparkSession, d: str, kinds=R.KINDS, k: int = 20, scope: DataFrame | None = None) -> R.Found:
    query, name = _ask(s, d)
    return R.rag_search(_t(s, d, "rag_documents"), MODEL, query, kinds, k, "broad", name, scope)


_WALLS = f"entity_id in (select id from ifc_entities where source_model_id = {MODEL} and lower(ifc_class) = 'ifcwall')"


def _walls(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "ifc_entities").where(f"source_model_id = {MODEL} and lower(ifc_class) = 'ifcwall'").select("id")


_BOTH = f"with c as (({_kind_sql('entity', 20)}) union all ({_kind_sql('relationship', 20)}))"
_add("rag_search_kinds", lambda s, d: _search(s, d).candidates.withColumn("similarity", F.round("similarity", 4)), _BOTH + " select kind, id, document_id, round(cos, 4) as similarity, rank, cos >= 0.5 as accepted from c")
_add("rag_search_scoped", lambda s, d: _search(s, d, ("entity",), 15, _walls(s, d)).candidates.select("kind", "id", "document_id", "rank"), f"select kind, id, document_id, rank from ({_kind_sql('entity', 15, _WALLS)})")
_add("rag_search_fused", lambda s, d: _search(s, d).fused.select("kind", "id", F.round("score", 6).alias("score")), _BOTH + " select kind, id, round(sum(1.0 / (60 + rank)), 6) as score from c group by 1, 2")


def _hydrated(s: SparkSession, d: str) -> DataFrame:
    return R.hydrate(_search(s, d).candidates, _t(s, d, "ifc_entities"), _t(s, d, "ifc_relationships"), _t(s, d, "relationship_members"), MODEL)


_NAMED = f"select id, global_id, ifc_class, json_extract_string(canonical_json, '$.identity.name') as name from ifc_entities where source_model_id = {MODEL}"
_add(
    "rag_hydrated",
    _hydrated,
    _BOTH + f""", a as (select distinct kind, id from c where cos >= 0.5), e as ({_NAMED}), p as (select * from e where id in (select id from a where kind = 'entity')),
r as (select id, global_id, ifc_class, name from ifc_relationships where source_model_id = {MODEL} and id in (select id from a where kind = 'relationship'))
select 'primary' as part, * from p union all select 'relationship', * from r
union all select 'context', * from e where id in (select entity_id from relationship_members where relationship_id in (select id from r)) and id not in (select id from p)""",
)
_add(
    "rag_endpoint_contexts",
    lambda s, d: R.hydrate(
        _t(s, d, "ifc_relationships").where(f"source_model_id = {MODEL}").select(F.lit("relationship").alias("kind"), "id", F.lit(True).alias("accepted")), _t(s, d, "ifc_entities"), _t(s, d, "ifc_relationships"), _t(s, d, "relationship_members"), MODEL
    ),
    f"""with e as ({_NAMED}), r as (select id, global_id, ifc_class, name from ifc_relationships where source_model_id = {MODEL})
select 'relationship' as part, * from r union all select 'context', * from e where id in (select entity_id from relationship_members where relationship_id in (select id from r))""",
)
_QUESTION = "How many walls and doors are there, and which door is on a roof?"
_add(
    "lexical_fallback",
    lambda s, d: R.lexical_fallback(_QUESTION, _t(s, d, "ifc_entities").groupBy("ifc_class").agg(F.count(F.lit(1)).alias("n"))),
    f"select ifc_class, count(*) as n, regexp_replace(lower(ifc_class), '^ifc', '') <> '' and contains('{_QUESTION.lower()}', regexp_replace(lower(ifc_class), '^ifc', '')) as matched from ifc_entities where ifc_class is not null group by 1 order by matched desc, n desc, ifc_class limit 15",
)


def _semantic(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "embeddings")
    cand = e.select(F.when(F.col("label") % 2 == 0, "class").otherwise("fact").alias("kind"), F.concat(F.lit("c"), F.floor(F.col("vec_id") / 2)).alias("name"), "embedding")
    present = e.where("vec_id % 6 = 0").select(F.concat(F.lit("c"), F.floor(F.col("vec_id") / 2)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    q = list(e.where("vec_id = 0").first().embedding)
    return R.semantic_resolution(q, cand, 8, present).withColumn("similarity", F.round("similarity", 4))


_add(
    "semantic_resolution",
    _semantic,
    """with c as (select case when label % 2 = 0 then 'class' else 'fact' end as kind, 'c' || cast(floor(vec_id / 2) as bigint) as name, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as sim from embeddings),
b as (select kind, name, max(sim) as sim from c where sim is not null group by 1, 2), p as (select *, row_number() over (partition by kind order by sim desc, name) as nth from b),
h as (select 'c' || cast(floor(vec_id / 2) as bigint) as name, count(*) as n from embeddings where vec_id % 6 = 0 group by 1),
j as (select p.kind, p.name, sim, coalesce(h.n, 0) as n from p left join h using (name) where nth <= 32)
select kind, name, round(sim, 4) as similarity, n, cast(row_number() over (partition by kind order by n > 0 desc, sim desc, name) as int) as rank from j qualify rank <= 8""",
)

# --- relationships and walks
_FIRST_REL = f"(select min(id) from ifc_relationships where source_model_id = {MODEL})"


def _first_rel(s: SparkSession, d: str):
    return _t(s, d, "ifc_relationships").where(f"source_model_id = {MODEL}").orderBy("id").select("id", "global_id").first()


_add("get_relationship", lambda s, d: G.get_relationship(_t(s, d, "ifc_relationships"), MODEL, _first_rel(s, d).id).select("id", "global_id", "ifc_class", "name"), f"select id, global_id, ifc_class, name from ifc_relationships where id = {_FIRST_REL}")
_add(
    "get_relationship_by_global_id",
    lambda s, d: G.get_relationship(_t(s, d, "ifc_relationships"), MODEL, global_id=_first_rel(s, d).global_id).select("id", "ifc_class"),
    f"select id, ifc_class from ifc_relationships where source_model_id = {MODEL} and global_id = (select global_id from ifc_relationships where id = {_FIRST_REL})",
)
_add(
    "list_relationships",
    lambda s, d: G.list_relationships(_t(s, d, "ifc_relationships"), MODEL, ("IfcRelAggregates", "IfcRelNests"), 30, 5).select("id", "ifc_class", "name"),
    f"select id, ifc_class, name from ifc_relationships where source_model_id = {MODEL} and ifc_class in ('IfcRelAggregates', 'IfcRelNests') order by name nulls last, id limit 30 offset 5",
)


def _context(s: SparkSession, d: str) -> DataFrame:
    hops, seeds = _walk(s, d, 2)
    return G.hydrated(seeds, hops, _t(s, d, "ifc_entities"), MODEL)


_add(
    "graph_hydrated",
    _context,
    _hops(2) + f""", e as ({_NAMED}), met as (select to_id as id from hops union select from_id from hops)
select 'primary' as part, * from e where id in (select id from seeds)
union all select 'context', * from e where id in (select id from met where id not in (select id from seeds) order by id limit 200)""",
)


def _retained(s: SparkSession, d: str) -> DataFrame:
    hops, seeds = _walk(s, d, 2)
    ends = G.endpoints(hops, seeds, _t(s, d, "ifc_entities"), ("IfcWall", "IfcSlab"))
    return G.retained(hops, seeds, ends, 10**9)[0].select("depth", "relationship_id", "from_id", "to_id", "direction")


_add(
    "graph_retained",
    _retained,
    _hops(2) + ", keep as (select id from seeds union select id from ifc_entities where ifc_class in ('IfcWall', 'IfcSlab') and id in (select to_id from hops)) select depth, relationship_id, from_id, to_id, direction from hops where from_id in (select id from keep) and to_id in (select id from keep)",
)

# --- fields and catalog
_ITEMS = (("a", "firerating"), ("b", "NetVolume"), ("c", "Height"), ("d", "no such field"), ("e", "load bearing"), ("f", "WIDTH"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame(list(_ITEMS), "item_id string, name string")
    return FL.resolve_names(names, FL.field_summary(_all_fields(s, d)), MODEL)


_add(
    "resolve_field",
    _resolved,
    _ALL_FIELDS + f""", s as (select section, set_name, field_name, count(distinct entity_id) as n_entities from f where source_model_id = {MODEL} group by 1, 2, 3),
a as (select * from (values {', '.join(repr(x) for x in _ITEMS)}) v(item_id, name)),
m as (select item_id, section, set_name, field_name, n_entities, name = field_name as exact from a join s on lower(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', '', 'g')) = lower(regexp_replace(field_name, '[^\\p{{L}}\\p{{N}}]', '', 'g'))),
k as (select *, max(exact::int) over (partition by item_id) as best from m)
select item_id, section, set_name, field_name, n_entities, case when exact then 'exact' else 'folded' end as rung, count(*) over (partition by item_id) as n_matches from k where exact or best = 0""",
)


def _cat(s: SparkSession, d: str) -> DataFrame:
    return C.catalog(_t(s, d, "ifc_source_models"), _t(s, d, "source_model_catalog_entries"), _t(s, d, "model_families"))


_CHOICE = "select m.id as source_model_id, m.file_fingerprint as source_fingerprint, {}e.status from ifc_source_models m left join source_model_catalog_entries e on e.source_model_id = m.id"
_add("selector_models", lambda s, d: C.selector_models(_cat(s, d)), _CHOICE.format("e.display_name, "))
_add("asset_identity", lambda s, d: C.asset_identity(_cat(s, d), MODEL), _CHOICE.format("") + f" where m.id = {MODEL}")
_add(
    "catalog_seed",
    lambda s, d: I.seed_catalog(_t(s, d, "ifc_source_models"), _t(s, d, "source_model_catalog_entries"), _t(s, d, "model_families"))[1],
    r"""select id as source_model_id, replace(lower(stem), ' ', '_') as family_key, stem as display_name, 'v1' as version_label, 1 as version_order, true as is_current, 'available' as status
from (select id, regexp_replace(regexp_replace(file_name, '^.*[/\\]', ''), '(.)\.[^.]*$', '\1') as stem from ifc_source_models where file_name is not null and id not in (select source_model_id from source_model_catalog_entries where source_model_id is not null))""",
)

# --- manifests and vocabularies
_G = "json_extract_string(canonical_json, '$.{}')"
_ATTRS = " union all ".join(f"select source_model_id, ifc_class, '{a}' as attribute, {_G.format('.'.join((FL.PATHS | FL.TYPE_PATHS)[a]))} as v from ifc_entities" for a in M.ATTRIBUTES)
_OBJECTS = f"""select source_model_id, ifc_class, attribute, count(*) as n_total, count(v) as n_filled, count(distinct v) as n_values,
  case when count(v) = 0 then 'absent' when count(v) >= count(*) then 'populated' else 'partial' end as coverage
from (select source_model_id, ifc_class, attribute, case when trim(v) <> '' and not regexp_full_match(trim(v), '[0-9A-Za-z_$]{{22}}') and not regexp_full_match(trim(v), '#[0-9]+') then trim(v) end as v from ({_ATTRS})) group by 1, 2, 3"""
_add("manifest_object_level", lambda s, d: M.object_level(_t(s, d, "ifc_entities")), _OBJECTS)
_add(
    "manifest_global_level",
    lambda s, d: M.global_level(_t(s, d, "ifc_entities")),
    "select source_model_id, count(*) as n_entities, count(distinct ifc_class) as n_classes, count(*) filter (where ifc_class = 'IfcBuildingStorey') as n_storeys, count(json_extract_string(canonical_json, '$.storey.global_id')) as n_in_storey, case when count(json_extract_string(canonical_json, '$.storey.global_id')) = 0 then 'absent' when count(json_extract_string(canonical_json, '$.storey.global_id')) >= count(*) then 'populated' else 'partial' end as containment from ifc_entities group by 1",
)
_add(
    "manifest_storeys",
    lambda s, d: M.storey_rows(_t(s, d, "ifc_entities")),
    "select source_model_id, global_id, json_extract_string(canonical_json, '$.identity.name') as name, try_cast(json_extract_string(canonical_json, '$.placement.elevation') as double) as elevation from ifc_entities where ifc_class = 'IfcBuildingStorey'",
)


def _missing(s: SparkSession, d: str) -> DataFrame:
    models = _t(s, d, "ifc_source_models")
    defaults, symbols = P.unit_tables(models)
    fields = _all_fields(s, d)
    facts = P.measure_facts(fields, defaults, symbols)
    return M.missing_capabilities(models, M.container_shapes(fields), facts, defaults, symbols, _t(s, d, "ifc_entities"))


_UNITS = """, mu as (select id, json_extract(extraction_metadata, '$.dimension_units') as u from ifc_source_models),
df as (select id, mt, json_extract_string(u, '$.defaults.' || mt) as unit_key from (select id, u, unnest(json_keys(u, '$.defaults')) as mt from mu)),
sy as (select id, unit_key, json_extract_string(u, '$.definitions."' || unit_key || '".symbol') as symbol from (select id, u, unnest(json_keys(u, '$.definitions')) as unit_key from mu) where coalesce(json_extract_string(u, '$.definitions."' || unit_key || '".resolved'), 'true') = 'true')"""
_add(
    "manifest_missing_capabilities",
    _missing,
    _ALL_FIELDS + _UNITS + """, g as (select source_model_id, section, set_name, count(distinct field_name) as nf, count(distinct entity_id) as ne, count(*) as ni from f where set_name is not null group by 1, 2, 3),
sh as (select *, not (nf >= 64 and nf / (ni / ne) >= 8) as reliable from g),
w as (select distinct source_model_id, regexp_extract(lower(x), '(propert|quantit)', 1) as k from (select source_model_id, unnest(from_json(extraction_warnings, '["varchar"]')) as x from ifc_entities) where regexp_matches(lower(x), 'propert|quantit'))
select source_model_id, replace(section, '_sets', '') || '_queries' as capability, set_name as scope, 'its fields share no schema' as reason from sh where not reliable
union all select source_model_id, case k when 'propert' then 'property_queries' else 'quantity_queries' end, null, 'extraction failed' from w
union all select id, v.s || '_queries', null, 'no reliable container' from ifc_source_models, (values ('property'), ('quantity')) v(s) where not exists (select 1 from sh where sh.source_model_id = id and sh.reliable and sh.section = v.s || '_sets')
union all select id, 'dimensional_queries', null, 'no measured field' from ifc_source_models where id not in (select source_model_id from f where measure_type is not null and value <> '')
union all select id, 'dimensional_queries', mt, 'default unit not resolved' from df where unit_key is not null and not exists (select 1 from sy where sy.id = df.id and sy.unit_key = df.unit_key and symbol is not null)""",
)
_COVER = """, t as (select source_model_id, ifc_class, count(*) as n_total from ifc_entities group by 1, 2),
cv as (select source_model_id, ifc_class, section, set_name, field_name, count(distinct case when value <> '' then entity_id end) as n_filled from f group by 1, 2, 3, 4, 5), cc as (select cv.*, n_total from cv join t using (source_model_id, ifc_class))"""
_add(
    "manifest_merged_coverage",
    lambda s, d: M.merged_coverage(M.field_coverage(_all_fields(s, d), _t(s, d, "ifc_entities"))),
    _ALL_FIELDS + _COVER + " select source_model_id, section, set_name, field_name, sum(n_filled) as n_filled, sum(n_total) as n_total, count(*) as n_classes, case when sum(n_filled) = 0 then 'absent' when sum(n_filled) >= sum(n_total) then 'populated' else 'partial' end as coverage from cc group by 1, 2, 3, 4",
)


def _concepts(s: SparkSession, d: str) -> DataFrame:
    entities = _t(s, d, "ifc_entities")
    found = M.concepts(M.object_level(entities), M.field_coverage(_all_fields(s, d), entities), _measures(s, d, _all_fields))
    return found.drop("unit_state")


_add(
    "manifest_concepts",
    _concepts,
    _ALL_FIELDS + _COVER + f""", ob as ({_OBJECTS})
select source_model_id, concat_ws(':', 'attribute', ifc_class, attribute) as concept, 'attribute' as kind, attribute as label, ifc_class, n_filled, n_total from ob where n_filled > 0
union all select source_model_id, concat_ws(':', section, ifc_class, nullif(coalesce(set_name, ''), ''), field_name), replace(section, '_sets', ''), field_name, ifc_class, n_filled, n_total from cc where n_filled > 0""",
)
_add("manifest_concept_count", lambda s, d: _concepts(s, d).groupBy("source_model_id").agg(F.countDistinct("kind", "label").alias("n_labels"), F.count(F.lit(1)).alias("n")), ORACLES["manifest_concepts"].replace("\nselect source_model_id, concat_ws", "\n, z as (select source_model_id, concat_ws", 1).replace(", ob as", ", ob as", 1) + ") select source_model_id, count(distinct kind || chr(1) || label) as n_labels, count(*) as n from z group by 1")
_LABEL = "case when lower(ifc_class) like '%wall%' then 'walls' when lower(ifc_class) like '%door%' or lower(ifc_class) like '%window%' then 'openings' else 'others' end"
_add(
    "label_histogram",
    lambda s, d: M.merged_labels(_t(s, d, "ifc_entities").groupBy("ifc_class").agg(F.count(F.lit(1)).alias("n")), F.expr(_LABEL)),
    f"select {_LABEL} as label, count(*) as n from ifc_entities group by 1",
)
_MATS = "select source_model_id, ifc_class, '{k}', unnest(list_distinct(list_transform(from_json(json_extract_string(canonical_json, '$.{p}'), '[\"json\"]'), lambda x: x ->> '$.{f}'))) from ifc_entities where json_type(json_extract_string(canonical_json, '$.{p}')) = 'ARRAY'"
_WORDS = f"""select source_model_id, ifc_class, 'predefined_type' as kind, {_G.format('meta.predefined_type')} as value from ifc_entities
union all select source_model_id, ifc_class, 'object_type', {_G.format('identity.object_type')} from ifc_entities
union all select source_model_id, ifc_class, 'type_name', {_G.format('type.name')} from ifc_entities
union all select source_model_id, ifc_class, 'storey_name', {_G.format('storey.name')} from ifc_entities
union all select source_model_id, ifc_class, 'name_stem', regexp_replace({_G.format('identity.name')}, '_\\(#\\d+\\)$', '') from ifc_entities
union all {_MATS.format(k='material', p='materials', f='name')}
union all {_MATS.format(k='classification', p='classifications', f='code')}
union all select source_model_id, ifc_class, 'property_set', unnest(json_keys(canonical_json, '$.property_sets')) from ifc_entities
union all select source_model_id, ifc_class, 'quantity_set', unnest(json_keys(canonical_json, '$.quantity_sets')) from ifc_entities"""
_NOISE = r"value is null or trim(value) = '' or length(value) > 60 or regexp_matches(value, '^#\d') or regexp_full_match(value, '[0-9A-Za-z_$]{22}') or regexp_full_match(lower(value), '[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}') or regexp_full_match(value, '-?\d+(\.\d+)?')"
_VOCAB = f"select source_model_id, ifc_class, kind, value, n, nth from (select source_model_id, ifc_class, kind, value, count(*) as n, cast(row_number() over (partition by source_model_id, ifc_class, kind order by count(*) desc, value) as int) as nth from ({_WORDS}) where not ({_NOISE}) group by 1, 2, 3, 4) where nth <= {M.VALUES}"
_add("vocabulary", lambda s, d: M.vocabulary(_t(s, d, "ifc_entities")), _VOCAB)
_add(
    "profile_texts",
    lambda s, d: M.profile_texts(M.vocabulary(_t(s, d, "ifc_entities")), P.class_counts(_t(s, d, "ifc_entities"))),
    f"""with v as ({_VOCAB}), l as (select source_model_id, ifc_class, replace(kind, '_', ' ') || ': ' || string_agg(value, ', ' order by nth) as line from v where nth <= 5 group by source_model_id, ifc_class, kind),
x as (select source_model_id, ifc_class, string_agg(line, '. ' order by line) as lines from l group by 1, 2), c as (select source_model_id, ifc_class, count(*) as n from ifc_entities group by 1, 2)
select c.source_model_id, c.ifc_class, concat_ws('. ', c.ifc_class || ': ' || n || ' objects', lines) as text from c left join x on x.source_model_id = c.source_model_id and x.ifc_class = c.ifc_class""",
)

# --- facts of objects, assembly and texts
_add(
    "object_facts",
    lambda s, d: W.object_facts(_t(s, d, "ifc_entities")).drop("family", "family_set", "family_property"),
    f"""select id, nullif(trim({_G.format('type.name')}), '') as type_name, nullif(trim({_G.format('type.global_id')}), '') as type_global_id,
  case when nullif(trim({_G.format('type.name')}), '') is not null or nullif(trim({_G.format('type.global_id')}), '') is not null then nullif(trim({_G.format('type.predefined_type')}), '') end as type_predefined_type,
  nullif(trim({_G.format('storey.name')}), '') as storey_name, nullif(trim({_G.format('storey.global_id')}), '') as storey_global_id,
  case when json_type(canonical_json, '$.placement.elevation') in ('DOUBLE', 'BIGINT', 'UBIGINT') then try_cast({_G.format('placement.elevation')} as double) end as elevation from ifc_entities""",
)
_add(
    "object_family",
    lambda s, d: W.object_facts(_t(s, d, "ifc_entities")).where("family is not null").select("id", "family", "family_set", "family_property"),
    _ALL_FIELDS + f""", h as (select entity_id, set_name, field_name, nullif(trim(value), '') as value from f where section = 'property_sets' and lower(regexp_replace(field_name, '[^\\p{{L}}\\p{{N}}]', '', 'g')) in ({', '.join(repr(x) for x in W.FAMILY_NAMES)}))
select entity_id as id, value as family, set_name as family_set, field_name as family_property from h where value is not null qualify row_number() over (partition by entity_id order by set_name, field_name) = 1""",
)
_OWNERS = """select distinct b.entity_id as child, a.entity_id as owner from relationship_members a join relationship_members b using (relationship_id) join ifc_relationships r on r.id = a.relationship_id
where r.ifc_class in ({}) and lower(a.role) like 'relating%' and lower(b.role) like 'related%' and a.entity_id is not null and b.entity_id is not null"""
_add(
    "entity_context",
    lambda s, d: I.resolve_context(_t(s, d, "ifc_entities"), _t(s, d, "ifc_relationships"), _t(s, d, "relationship_members")),
    f"""with recursive o as (select child, min(owner) as owner from ({_OWNERS.format("'IfcRelContainedInSpatialStructure', 'IfcRelAggregates'")}) group by 1),
k as (select id, lower(ifc_class) as c, json_extract_string(canonical_json, '$.identity.name') as name, global_id from ifc_entities),
up as (select o.child, k.id as owner, k.c, k.name, k.global_id from o join k on k.id = o.owner),
w as (select child as id, owner, c, 1 as step from up union all select w.id, up.owner, up.c, step + 1 from w join up on up.child = w.owner where w.c <> 'ifcbuildingstorey' and step < 4),
st as (select w.id, w.owner from w where c = 'ifcbuildingstorey'),
ty as (select child, min(owner) as owner from ({_OWNERS.format("'IfcRelDefinesByType'")}) group by 1)
select e.id, st.owner as storey_id, ks.name as storey_name, ks.global_id as storey_global_id, kt.id as type_id, kt.name as type_name, kt.global_id as type_global_id
from ifc_entities e left join st on st.id = e.id left join k ks on ks.id = st.owner left join ty on ty.child = e.id left join k kt on kt.id = ty.owner""",
)


def _assembled(s: SparkSession, d: str) -> DataFrame:
    flat = _t(s, d, "ifc_entities").select("id", "ifc_class", "global_id", *(FL.as_text(FieldRef(FieldKind.ATTRIBUTE, a)).alias(a) for a in ("name", "description", "tag", "storey_name")))
    made = I.entity_record(flat)
    return made.select("id", *(F.get_json_object("canonical_json", p).alias(a) for a, p in (("class", "$.meta.ifc_class"), ("name", "$.identity.name"), ("tag", "$.identity.tag"), ("storey", "$.storey.name"))), F.size("warnings").alias("n_warnings"))


_add(
    "assembled_records",
    _assembled,
    f"select id, trim(ifc_class) as class, trim({_G.format('identity.name')}) as name, trim({_G.format('identity.tag')}) as tag, trim({_G.format('storey.name')}) as storey, 0 as n_warnings from ifc_entities",
)


def _assembled_rels(s: SparkSession, d: str) -> DataFrame:
    made = I.relationship_record(_t(s, d, "ifc_relationships"), _t(s, d, "relationship_members")).withColumn("source_model_id", F.lit(0))
    return I.explode_members(made).groupBy("relationship_id", "role").agg(F.count(F.lit(1)).alias("n"), F.min("endpoint_global_id").alias("first_gid"), F.max("endpoint_name").alias("last_name"))


_add("assembled_relationships", _assembled_rels, "select relationship_id, role, count(*) as n, min(endpoint_global_id) as first_gid, max(endpoint_name) as last_name from relationship_members where role is not null and relationship_id in (select id from ifc_relationships) group by 1, 2")


def _upserted(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "rag_documents").select("id", *I.DOCUMENT_KEY, "generation_timestamp", "text_hash")
    early = docs.where("generation_timestamp < timestamp_ntz'2024-07-01'")
    return I.upsert_documents(early, docs).groupBy("document_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.crc32(F.coalesce("text_hash", F.lit("")).cast("binary")) % 1000).alias("check"))


_add("documents_upsert", lambda s, d: _upserted(s, d).drop("check"), "select document_type, count(*) as n from (select distinct entity_id, relationship_id, document_type, text_template_version, embedding_model from rag_documents) group by 1")
_add(
    "normalize_text",
    lambda s, d: _t(s, d, "ifc_entities").select("id", normalized(FL.as_text(FieldRef(FieldKind.ATTRIBUTE, "name"))).alias("name")),
    f"select id, trim(regexp_replace(replace(strip_accents(lower({_G.format('identity.name')})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as name from ifc_entities",
)


def _embedded(s: SparkSession, d: str) -> DataFrame:
    docs = D.embed(D.entity_documents(_t(s, d, "ifc_entities")), D.hash_encoder(64), 64)
    return docs.select(F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm")).groupBy("dim", "norm").agg(F.count(F.lit(1)).alias("n"))


_add("doc_embed", _embedded, "select 64 as dim, cast(1.0 as double) as norm, count(*) as n from ifc_entities where json_valid(canonical_json)")


#: Between the first and the last import of the test data.
_DAY = "2024-06-01"


def _generations(s: SparkSession, d: str) -> DataFrame:
    """Two real states of the descriptions, by what they describe: as of a day, and as of now."""
    docs = _t(s, d, "rag_documents").where("generation_timestamp is not null")
    last = lambda rows: rows.groupBy(F.coalesce("entity_id", F.lit(-1)).alias("entity"), F.coalesce("relationship_id", F.lit(-1)).alias("relationship")).agg(
        *(F.max_by(c, F.struct("generation_timestamp", "id")).alias(c) for c in ("text_hash", "source_hash"))
    )
    prior = last(docs.where(f"generation_timestamp < timestamp_ntz'{_DAY}'"))
    return D.classify_changes(prior, last(docs), ["entity", "relationship"], ["text_hash", "source_hash"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_add(
    "doc_incremental_classify",
    _generations,
    f"""with r as (select coalesce(entity_id, -1) as e, coalesce(relationship_id, -1) as x, text_hash, source_hash, generation_timestamp as t, id from rag_documents where generation_timestamp is not null),
n as (select * from r qualify row_number() over (partition by e, x order by t desc, id desc) = 1), p as (select * from r where t < timestamp '{_DAY}' qualify row_number() over (partition by e, x order by t desc, id desc) = 1)
select case when p.id is null then 'new' when p.text_hash is not distinct from n.text_hash and p.source_hash is not distinct from n.source_hash then 'unchanged' else 'changed' end as state, count(*) as n from n left join p on p.e = n.e and p.x = n.x group by 1""",
)

#: An object's display rows; numbers are shown without a fraction of zero.
_GID = "2H_lRmEQgaUOJXBRoQsBHR"
QUERIES["entity_details"] = lambda s, d: E.details(_t(s, d, "ifc_entities"), MODEL, _GID)
ORACLES["entity_details"] = _ALL_FIELDS + f""", e as (select id, canonical_json from ifc_entities where source_model_id = {MODEL} and global_id = '{_GID}'),
o as (select section, set_name, field_name, case when kind in ('DOUBLE', 'BIGINT', 'UBIGINT') then regexp_replace(value, '\\.0+$', '') else left(value, 120) end as value, cast(row_number() over (partition by section order by set_name, field_name) as int) as nth from f where value <> '' and entity_id in (select id from e)),
m as (select list_distinct(list_transform(from_json(json_extract_string(canonical_json, '$.materials'), '["json"]'), lambda x: x ->> '$.name')) as names from e),
u as (select unnest(names[:12]) as value, unnest(range(1, least(len(names), 12) + 1)) as nth from m)
select * from o where nth <= 24 union all select 'materials', null, 'name', left(value, 120), cast(nth as int) from u"""
