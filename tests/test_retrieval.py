import json
import os
import time

import pytest
from pyspark.sql import functions as F

from trellisq.api import Engine
from trellisq.model import AmbiguousField, FieldKind, FieldRef, PlanError
from trellisq.operators import catalog as C
from trellisq.operators import fields as FL
from trellisq.operators import graph as G
from trellisq.operators import manifest as M
from trellisq.operators import retrieval as R
from trellisq.operators import viewer as W
from trellisq.sources import ingest as I

DOC = "id long, source_model_id int, source_kind string, entity_id long, relationship_id long, embedding_model string, embedding array<float>, document_text string"


@pytest.fixture
def docs(spark):
    rows = [
        (10, 1, "entity", 1, None, "m", [1.0, 0.0], "a"), (11, 1, "entity", 2, None, "m", [0.0, 1.0], "b"), (12, 1, "entity", 3, None, "m", None, "c"), (13, 1, "entity", 4, None, "other", [1.0, 0.0], "d"),
        (14, 1, "entity", 2, None, "m", [0.8, 0.6], "b again"), (20, 1, "relationship", None, 7, "m", [0.9, 0.1], "r"), (21, 2, "relationship", None, 8, "m", [1.0, 0.0], "other model"),
    ]
    return spark.createDataFrame(rows, DOC)


def test_search_and_warnings(spark, docs):
    found = R.rag_search(docs, 1, [1.0, 0.0], embedding_model="m")
    rows = {(r.kind, r.id, r["rank"]): r.accepted for r in found.candidates.collect()}
    assert rows == {("entity", 1, 1): True, ("entity", 2, 2): True, ("entity", 2, 3): False, ("relationship", 7, 1): True}
    assert found.warnings == () and [(r.kind, r.id) for r in found.fused.collect()][0] == ("entity", 2)
    one = R.rag_search(docs, 1, [1.0, 0.0], ("entity",))
    assert one.fused is None
    none = spark.createDataFrame([], "id long")
    assert R.rag_search(docs, 1, [1.0, 0.0], scope=none).warnings == (R.EMPTY_SCOPE,)
    assert R.rag_search(docs, 1, [-1.0, 0.0]).warnings == (R.NOT_SUFFICIENT,)
    assert R.rag_search(docs, 9, [1.0, 0.0]).candidates.count() == 0
    with pytest.raises(PlanError):
        R.rag_search(docs, 1, [1.0, 0.0], profile="none")


def test_hydration_leaves_out_what_is_primary(spark, docs, entities):
    ents = entities([(i, "IfcWall", {"identity": {"name": f"n{i}"}}) for i in (1, 2, 3)])
    rels = spark.createDataFrame([(7, 1, "g7", "IfcRelAggregates", "rel")], "id long, source_model_id int, global_id string, ifc_class string, name string")
    members = spark.createDataFrame([(1, 7, 1), (2, 7, 3), (3, 7, None), (4, 7, 99)], "id long, relationship_id long, entity_id long")
    cand = R.rag_search(docs, 1, [1.0, 0.0], embedding_model="m").candidates
    got = {(r.part, r.id) for r in R.hydrate(cand, ents, rels, members, 1).collect()}
    assert got == {("primary", 1), ("primary", 2), ("relationship", 7), ("context", 3)}
    assert {r.part for r in R.hydrate(cand, ents, rels, members, 1, False).collect()} == {"primary", "relationship"}
    assert [r.id for r in R.selected_summaries(ents, 1, [3, 99, 1, 3]).collect()] == [3, 1] and R.selected_summaries(ents, 1, []).count() == 0
    with pytest.raises(PlanError):
        R.selected_summaries(ents, 1, [1] * 6)


def test_fallback(spark):
    counts = spark.createDataFrame([("IfcWall", 5), ("IfcDoor", 9), ("IfcSlab", 90), (None, 3), ("Ifc", 100)], "ifc_class string, n long")
    assert [(r.ifc_class, r.matched) for r in R.lexical_fallback("Which DOOR is in a wall?", counts, 3).collect()] == [("IfcDoor", True), ("IfcWall", True), ("Ifc", False)]


def test_walks_and_relationships(spark, entities):
    hops = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (2, 2, 4)], "depth int, from_id long, to_id long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    kept, cut = G.retained(hops, ids(1), ids(2))
    assert not cut and [(r.from_id, r.to_id) for r in kept.collect()] == [(1, 2)]
    assert G.retained(hops, ids(1), ids(2), cap=2)[1] and G.retained(hops, ids(1), ids(2), cap=2)[0].count() == 0
    ents = entities([(i, "IfcWall", {}) for i in range(1, 5)])
    assert {(r.part, r.id) for r in G.hydrated(ids(1), hops, ents, 1, cap=2).collect()} == {("primary", 1), ("context", 2), ("context", 3)}
    rels = spark.createDataFrame([(7, 1, "g", "b"), (8, 1, "g", None), (9, 1, "h", "a")], "id long, source_model_id int, global_id string, name string")
    assert G.get_relationship(rels, 1, 7).count() == 1 and G.get_relationship(rels, 1, global_id="g").count() == 2 and G.get_relationship(rels, 2, 7).count() == 0
    assert [r.id for r in G.list_relationships(rels, 1).collect()] == [9, 7, 8]
    members = spark.createDataFrame([(1, 7, "r", 0)], "id long, relationship_id long, role string, member_order int")
    assert G.relationship_members(members, 7, rels).count() == 1
    for bad in (lambda: G.relationship_members(members, 99, rels), lambda: G.get_relationship(rels, 1), lambda: G.list_relationships(rels, 1, limit=0)):
        with pytest.raises(PlanError):
            bad()


def test_fields_are_resolved_or_refused(spark, entities):
    rec = {"property_sets": {"P": {"Fire Rating": {"value": "a"}}}, "quantity_sets": {"Q": {"Width": {"value": 1}}, "R": {"Width": {"value": 2}, "Depth": {"value": 1}}}, "measurements": {"Height": {"value": 1}}}
    summary = FL.field_summary(FL.entity_fields(entities([(1, "IfcWall", rec)])))
    names = spark.createDataFrame([("a", "firerating", None), ("b", "Width", None), ("c", "Width", "R"), ("d", "!!", None)], "item_id string, name string, set_name string")
    got = {(r.item_id, r.set_name, r.field_name, r.rung, r.n_matches) for r in FL.resolve_names(names, summary, 1).collect()}
    assert got == {("a", "P", "Fire Rating", "folded", 1), ("b", "Q", "Width", "exact", 2), ("b", "R", "Width", "exact", 2), ("c", "R", "Width", "exact", 1)}
    assert FL.resolve_field(summary, 1, FieldRef(FieldKind.QUANTITY, "Width", "Q")).set_name == "Q" and FL.resolve_field(summary, 1, FieldRef(FieldKind.MEASUREMENT, "Height"))
    with pytest.raises(PlanError):
        FL.resolve_field(summary, 1, FieldRef(FieldKind.PROPERTY, "Width", "P"))
    with pytest.raises(AmbiguousField):
        FL.resolve_dimension(summary, 1, "Width")


def test_viewer_facts(entities):
    rows = entities([
        (1, "IfcWall", {"type": {"name": " T ", "predefined_type": "X"}, "property_sets": {"b": {"Reference": {"value": "late"}}, "a": {"Family Name": {"value": " "}, "family": {"value": "F"}}}, "storey": {"name": ""}, "placement": {"elevation": 3}}),
        (2, "IfcWall", {"type": {"predefined_type": "X"}, "property_sets": "odd", "placement": {"elevation": "3"}}), (3, "IfcWall", None), (4, "IfcWall", "broken"),
    ])
    got = {r.id: r for r in W.object_facts(rows).collect()}
    assert (got[1].type_name, got[1].type_predefined_type, got[1].family, got[1].family_set, got[1].storey_name, got[1].elevation) == ("T", "X", "F", "a", None, 3.0)
    assert got[2].type_predefined_type is None and got[2].elevation is None and got[3].family is None and got[4].type_name is None


def test_artifacts_excerpts_and_labels(spark):
    t = spark.createDataFrame([("#12",), ("0123456789012345678901",), (" ",), (None,), ("90",), ("EI " * 40,), ("#12 a",)], "t string")
    assert [r.x for r in t.select(M.is_artifact(F.col("t")).alias("x")).collect()] == [True, True, True, True, False, False, False]
    assert spark.range(1).select(M.excerpt(F.lit("one two three"), 9).alias("x")).first().x == "one two…"
    assert spark.range(1).select(M.excerpt(F.lit("one two"), 9).alias("x")).first().x == "one two"
    counts = spark.createDataFrame([("IfcWall", 2), ("IfcWallStandardCase", 3), ("IfcDoor", 0)], "ifc_class string, n long")
    assert [(r.label, r.n) for r in M.merged_labels(counts, F.when(F.col("ifc_class").contains("Wall"), "walls").otherwise("rest")).collect()] == [("walls", 5)]


def test_profile_documents_are_checked():
    content = {s: {} for s in M.SECTIONS}
    good = {"identity": {"source_model_id": 1, "file_fingerprint": "f", "version": 1, "content_hash": I.content_hash(content)}, "content": content}
    assert M.problems_of(good, 1, I.content_hash) == []
    bad = {"object_level": [{"id": "a", "coverage": "full"}, {"id": "a", "unit_state": "uniform"}], "container_level": {"unit_state": "odd"}, "relationship_level": {}}
    got = M.problems_of({"identity": {"version": 2}, "content": bad}, 1, I.content_hash)
    for word in ("global_level is missing", "coverage is 'full'", "id a repeats", "uniform in no unit", "unit_state is 'odd'", "content_hash is not", "version 2", "file_fingerprint is missing"):
        assert any(word in g for g in got), word
    assert M.problems_of({}, 1, I.content_hash)


def test_cache_and_ontology(spark):
    made = []
    cache = M.Cache()
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get("v", ("f", 1), make) is cache.get("v", ("f", 1), make) and len(made) == 1
    cache.get("v", ("g", 1), make)
    assert len(made) == 2
    rows = [("IfcRoot", None), ("IfcObject", "IfcRoot"), ("IfcProduct", "IfcObject"), ("IfcWall", "IfcProduct"), ("IfcRelationship", "IfcRoot"), ("IfcRelAggregates", "IfcRelationship"), ("A", "B"), ("B", "A"), (None, "A")]
    got = {r["class"]: r for r in M.ontology(spark.createDataFrame([(c, p, None) for c, p in rows], "class string, parent string, description string")).collect()}
    assert got["IfcWall"].ancestors == ["IfcProduct", "IfcObject", "IfcRoot"] and got["IfcWall"].role == "product" and got["IfcRelAggregates"].role == "relationship"
    assert got["IfcRoot"].ancestors == [] and got["A"].ancestors == ["B"] and got["IfcWall"].words == ["wall"]


def test_records_are_assembled(spark):
    rows = spark.createDataFrame([(1, "IfcWall", "g", 'a "b"', float("nan")), (2, None, None, None, 2.5)], "id long, ifc_class string, global_id string, name string, elevation double")
    got = {r.id: (json.loads(r.canonical_json), r.warnings) for r in I.entity_record(rows).collect()}
    assert got[1] == ({"meta": {"ifc_class": "IfcWall", "global_id": "g"}, "identity": {"name": 'a "b"'}}, ["elevation is no finite number"]) and got[2] == ({"placement": {"elevation": "2.5"}}, [])
    rels = spark.createDataFrame([(7, "g", "IfcRelAggregates", "n", None), (8, "h", "IfcRelAggregates", None, None)], "id long, global_id string, ifc_class string, name string, description string")
    members = spark.createDataFrame([(1, 7, "RelatingObject", None, 5, "a"), (2, 7, 'Rel"ated', 1, 6, "c"), (3, 7, 'Rel"ated', 0, 6, "b")], "id long, relationship_id long, role string, member_order int, endpoint_step_id int, endpoint_global_id string")
    members = members.withColumn("endpoint_ifc_class", F.lit("IfcWall")).withColumn("endpoint_name", F.lit(None).cast("string"))
    got = {r.id: json.loads(r.canonical_json) for r in I.relationship_record(rels, members).collect()}
    assert got[7]["endpoints"] == {"RelatingObject": {"step_id": 5, "ifc_class": "IfcWall", "global_id": "a"}, 'Rel"ated': [{"step_id": 6, "ifc_class": "IfcWall", "global_id": "b"}, {"step_id": 6, "ifc_class": "IfcWall", "global_id": "c"}]}
    assert got[8]["endpoints"] == {} and got[7]["identity"] == {"name": "n"}


def test_context_from_relationships(spark, entities):
    ents = entities([(1, "IfcBuildingStorey", {"identity": {"name": "L1"}}), (2, "IfcSpace", {}), (3, "IfcWall", {}), (4, "IfcDoor", {}), (5, "IfcDoorType", {"identity": {"name": "T"}}), (6, "IfcWall", {})])
    rels = spark.createDataFrame([(1, "IfcRelAggregates"), (2, "IfcRelContainedInSpatialStructure"), (3, "IfcRelDefinesByType"), (4, "IfcRelAggregates")], "id long, ifc_class string")
    rows = [(1, "RelatingObject", 1), (1, "RelatedObjects", 2), (2, "RelatingStructure", 2), (2, "RelatedElements", 3), (3, "RelatingType", 5), (3, "RelatedObjects", 4), (4, "RelatingObject", 6), (4, "RelatedObjects", 6)]
    members = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, relationship_id long, role string, entity_id long")
    got = {r.id: (r.storey_name, r.type_name) for r in I.resolve_context(ents, rels, members).collect()}
    assert got == {1: (None, None), 2: ("L1", None), 3: ("L1", None), 4: (None, "T"), 5: (None, None), 6: (None, None)}


def test_sinks_and_ledger(spark, tmp_path):
    cols = "id long, entity_id long, relationship_id long, document_type string, text_template_version string, embedding_model string, generation_timestamp timestamp, text_hash string"
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    stored = spark.createDataFrame([(1, 5, None, "t", "v", "m", day(1), "old"), (2, 6, None, "t", "v", "m", day(1), "kept")], cols)
    new = spark.createDataFrame([(3, 5, None, "t", "v", "m", day(2), "new"), (4, 5, None, "t", "v", "m", None, "undated"), (5, None, 5, "t", "v", "m", day(2), "rel")], cols)
    for _ in range(2):
        out = I.upsert_documents(stored, new)
        assert {r.text_hash for r in out.collect()} == {"new", "kept", "rel"}
    empty = spark.createDataFrame([], "version string, checksum string, applied_at timestamp")
    steps = [("1", "select 1"), ("2", "select 2")]
    ledger = I.apply_pending(spark, empty, steps)
    assert ledger.count() == 2 and I.pending(ledger, steps) == [] and [p[0] for p in I.pending(ledger, [*steps, ("3", "select 3")])] == ["3"]
    with pytest.raises(ValueError):
        I.pending(ledger, [("1", "select 9")])
    (tmp_path / "c.jsonl").write_text('{"question": "q", "expected_route": "sql"}\n{"question": "r", "relevant_canonical_ids": [1, 2]}\n')
    cases = {r.question: r for r in I.read_cases(spark, str(tmp_path / "c.jsonl")).collect()}
    assert cases["q"].relevant_canonical_ids == [] and cases["r"].relevant_canonical_ids == [1, 2]
    (tmp_path / "d.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        I.read_cases(spark, str(tmp_path / "d.jsonl")).collect()


def test_reading_only_and_in_time(spark):
    assert I.read_only("-- drop table\nselect 'insert' as x") and I.read_only("with a as (select 1) select * from a")
    for bad in ("insert into t values (1)", "with a as (select 1) insert into t select * from a", "", "drop table t"):
        with pytest.raises(ValueError):
            I.read_only(bad)
    assert I.within_time(spark, 60, lambda: spark.range(5).count()) == 5
    slow = F.udf(lambda x: time.sleep(2) or x, "long")
    with pytest.raises(TimeoutError):
        I.within_time(spark, 1.5, lambda: spark.range(400).select(slow("id")).collect())
    assert spark.range(5).count() == 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_surface(spark):
    from trellisq.plans import binding as B

    e = Engine(spark, "/root/testdata/sf0.001")
    assert e.health()["status"] == "ok" and e.ready() == {"ready": True, "missing": []} and e.models().count() == 60
    one = e._t("ifc_entities").orderBy("id").first()
    facts, rows = e.details(one.source_model_id, one.global_id)
    assert facts.count() >= 1 and e.resolve(one.source_model_id, [one.global_id, None]).count() == 1
    r = e.query([B.Part("p", B.Operation.COUNT, (one.ifc_class,))], one.source_model_id)
    assert r[0].total >= 1 and e.highlight(B.Part("p", B.Operation.COUNT, (one.ifc_class,)), one.source_model_id).count() == r[0].total
    assert e.floors(one.source_model_id).count() >= 0
    for bad in (lambda: e.model(-1), lambda: e.details(one.source_model_id, "no"), lambda: e.query([], one.source_model_id), lambda: e.relationship(one.source_model_id, -1)):
        with pytest.raises(PlanError):
            bad()
    assert not Engine(spark, "/nowhere").ready()["ready"]


def test_seeding(spark):
    models = spark.createDataFrame([(1, "/a/Big House.ifc"), (2, "b.ifc"), (3, None)], "id int, file_name string")
    entries = spark.createDataFrame([(2,)], "source_model_id int")
    fams, new = I.seed_catalog(models, entries, spark.createDataFrame([("x",)], "family_key string"))
    assert [(r.family_key, r.display_name) for r in fams.collect()] == [("big_house", "Big House")] and [r.source_model_id for r in new.collect()] == [1]
