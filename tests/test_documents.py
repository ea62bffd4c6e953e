import pytest
from pyspark.sql import functions as F

from trellisq.operators import documents as D
from trellisq.sources import ingest as I


def test_sentences(spark, entities):
    record = {
        "meta": {"ifc_class": "IfcWall", "global_id": "g1", "predefined_type": "NOTDEFINED"}, "identity": {"name": "W\t 1", "description": "old"}, "storey": {"name": "L1"}, "type": {"name": "T"}, "materials": [{"name": "brick"}, {"name": "brick"}, {"name": None}],
        "classifications": [{"code": "A1", "system": None, "description": "x"}, {"code": None}], "placement": {"elevation": 2.5}, "property_sets": {"B": {"y": {"value": True}, "x": {"value": ""}}, "A": {"z": {"value": 1}}, "_err": {"q": {"value": 1}}, "C": "text"}, "quantity_sets": {"Q": {"W": {"value": 3}}},
    }
    rows = entities([(1, "IfcWall", record), (2, "IfcWall", None), (3, "IfcWall", "broken"), (4, "IfcWall", {})])
    got = {r.id: r for r in D.entity_documents(rows).collect()}
    assert set(got) == {1, 4}
    assert got[1].document_text == (
        "This is an IfcWall entity. Its name is 'W 1'. Its IFC GlobalId is g1. Description: old. Located on storey 'L1'. Element type: 'T'. Material: 'brick'. Classification A1 (unknown): x. Storey elevation: 2.5. Property 'z' in 'A': 1. Property 'y' in 'B': true. Quantity 'W' in 'Q': 3."
    )
    assert not got[1].text_truncated and got[1].original_token_count == got[1].encoded_token_count
    assert D.entity_documents(rows).select("text_hash").collect() == D.entity_documents(rows).select("text_hash").collect()


def test_budget_skips_and_goes_on(spark):
    s = spark.createDataFrame([(1, [(0, 0, "short one"), (1, 1, "x" * 50), (2, 2, "tail")])], "id long, sentences array<struct<priority:int,place:int,sentence:string>>")
    r = D.render(s, max_chars=20).first()
    assert r.document_text == "short one tail" and r.text_truncated


def test_relationship_text(spark, entities):
    rec = {"meta": {"ifc_class": "IfcRelAggregates", "global_id": "r"}, "identity": {"name": None}, "scalars": {"b": 2, "a": "x", "OwnerHistory_step_id": 5}, "endpoints": {"RelatedObjects": [{"ifc_class": "IfcWall", "name": "W", "global_id": "w"}, {"ifc_class": "IfcDoor", "name": None}], "RelatingObject": {"ifc_class": "IfcSite", "global_id": "s"}, "Odd": "x"}}
    text = D.relationship_documents(entities([(1, "IfcRelAggregates", rec)])).first().document_text
    assert text == "This is an IfcRelAggregates relationship. Its GlobalId is r. a: x. b: 2. RelatingObject: IfcSite (GlobalId: s). RelatedObjects[0]: IfcWall (GlobalId: w, Name: 'W'). RelatedObjects[1]: IfcDoor."
    members = spark.createDataFrame([(1, 1, "RelatedObjects", 0, 77), (2, 1, "RelatingObject", None, 78), (3, 1, "RelatedObjects", 1, None)], "id long, relationship_id long, role string, member_order int, entity_id long")
    named = D.relationship_documents(entities([(1, "IfcRelAggregates", rec)]), members).first().document_text
    assert named.endswith("RelatingObject: IfcSite (GlobalId: s, Entity ID: 78). RelatedObjects[0]: IfcWall (GlobalId: w, Name: 'W', Entity ID: 77). RelatedObjects[1]: IfcDoor.")


def test_composed_and_hashed(spark, entities):
    rec = lambda name, turned=False: dict(reversed(list({"meta": {"ifc_class": "IfcWall", "global_id": "g"}, "identity": {"name": name}}.items()))) if turned else {"meta": {"ifc_class": "IfcWall", "global_id": "g"}, "identity": {"name": name}}
    got = {r.id: r for r in D.entity_documents(entities([(1, "IfcWall", rec("Tu\u0308r")), (2, "IfcWall", rec("T\u00fcr")), (3, "IfcWall", rec("T\u00fcr", True)), (4, "IfcWall", '{"identity": {"name": "Tu\\u0308r"}}')])).collect()}
    assert got[1].document_text == got[2].document_text and "'T\u00fcr'" in got[1].document_text and "'T\u00fcr'" in got[4].document_text
    assert got[2].source_hash == got[3].source_hash != got[1].source_hash


def test_changes(spark):
    schema = "id long, h string"
    prior = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (None, "n")], schema)
    now = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (5, "e"), (None, "n")], schema)
    got = {r.id: r.state for r in D.classify_changes(prior, now, ["id"], ["h"]).collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "removed", 5: "new", None: "unchanged"}
    assert {r.state: r.n for r in I.import_report(now, now, ["id"], ["h"]).collect()} == {"unchanged": 5}


def test_embedding(spark):
    docs = spark.createDataFrame([(1, "wall one"), (2, None), (3, "")], "id long, document_text string")
    got = {r.id: r.embedding for r in D.embed(docs, D.hash_encoder(8), 8).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-6) and sum(got[2]) == 0
    with pytest.raises(Exception, match="another shape"):
        D.embed(docs, D.hash_encoder(4), 8).collect()
    prior = spark.createDataFrame([(1, "s", "t", [0.1] * 8), (2, "s", "t", None), (3, "s", "old", [0.1] * 8), (4, "s", "t", [0.1])], "id long, source_hash string, text_hash string, embedding array<float>")
    now = spark.createDataFrame([(i, "s", "t") for i in range(1, 6)], "id long, source_hash string, text_hash string")
    assert sorted(r.id for r in D.to_embed(prior, now, 8, ["id"]).collect()) == [2, 3, 4, 5]


def test_ingest(spark, entities, tmp_path):
    rec = {"endpoints": {"RelatedObjects": [{"step_id": 1, "global_id": "g1"}, None, "x", {"global_id": "none"}], "RelatingObject": {"global_id": "g2"}, "Odd": 5}}
    m = I.explode_members(entities([(7, "IfcRelAggregates", rec), (8, "IfcRelAggregates", None)]))
    ents = entities([(1, "IfcWall", {}), (2, "IfcWall", {})]).select("id", "source_model_id", "global_id")
    got = {(r.role, r.member_order, r.endpoint_global_id, r.entity_id) for r in I.resolve_endpoints(m, ents).collect()}
    assert got == {("RelatedObjects", 0, "g1", 1), ("RelatedObjects", 3, "none", None), ("RelatingObject", None, "g2", 2)}
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    merged = I.upsert(stored, spark.createDataFrame([(2, "B"), (3, "c"), (None, "N")], "k long, v string"), ["k"])
    assert {(r.k, r.v) for r in merged.collect()} == {(1, "a"), (2, "B"), (3, "c"), (None, "N")}
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "id long, source_model_id int, v string")
    for _ in range(2):
        I.write_models(rows, path)
    I.write_models(rows.where("source_model_id = 2").withColumn("v", F.lit("B")), path)
    assert {(r.id, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "B")}
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert I.fingerprints(spark, str(tmp_path / "f.bin")).first().file_fingerprint == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_profile_file(tmp_path):
    path = str(tmp_path / "p.json")
    assert I.read_profile(path) == ("missing", None)
    digest = I.write_profile({"source_model_id": 1, "fields": {"b": 1, "a": "ä"}}, path)
    state, body = I.read_profile(path, 1)
    assert state == "ready" and I.content_hash(body) == digest and I.write_profile({"fields": {"a": "ä", "b": 1}, "source_model_id": 1}, path) == digest
    assert I.read_profile(path, 2)[0] == "stale"
    (tmp_path / "p.json").write_text((tmp_path / "p.json").read_text().replace("ä", "x"))
    assert I.read_profile(path)[0] == "unavailable"
    (tmp_path / "p.json").write_text("{broken")
    assert I.read_profile(path)[0] == "unavailable"


def test_scan_report(spark):
    rows = spark.createDataFrame([(1, "a", "IfcWall"), (1, "a", "IfcWall"), (1, None, "IfcWall"), (1, "r", "IfcRelAggregates"), (2, " ", "IfcDoor")], "source_model_id int, global_id string, ifc_class string")
    got = {r.source_model_id: tuple(r)[1:] for r in I.scan_report(rows).collect()}
    assert got == {1: (4, 2, 1, 1, 1), 2: (1, 0, 0, 1, 0)} and I.eligible(rows).count() == 2
