"""Queries that must cover all models and sections."""

import json
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def test_schema_catalog_has_all_sections(spark):
    rows = entry.queries()["schema_catalog_all"](spark, SMALL).select("section").distinct().collect()
    assert {r.section for r in rows} == {"property_sets", "quantity_sets", "measurements", "entity_classes", "relationship_classes"}


@pytest.mark.parametrize("name", ["profile_field_coverage_all", "measure_facts_ladder_all"])
def test_measurements_are_profiled(spark, name):
    assert entry.queries()[name](spark, SMALL).where("section = 'measurements'").count() > 0


def test_measurements_are_candidates(spark, entities, tmp_path):
    record = {"measurements": {"fire rating": {"value": 1, "measure_type": "IfcReal"}}}
    entities([(1, "IfcWall", json.dumps(record))]).write.parquet(f"{tmp_path}/ifc_entities.parquet")
    assert "measurements.fire rating" in {r.name for r in entry.queries()["candidate_ranking"](spark, str(tmp_path)).collect()}


def test_unresolved_endpoints_of_all_models(spark):
    q = entry.queries()
    members = spark.read.parquet(f"{SMALL}/relationship_members.parquet").select("id", "source_model_id")
    assert q["unresolved_endpoints_all"](spark, SMALL).join(members, "id").select("source_model_id").distinct().count() > 1


def test_natural_sort_has_all_rows(spark):
    """Rows without a name too, which come last."""
    rows = spark.read.parquet(f"{SMALL}/ifc_entities.parquet")
    got = [r.name is None for r in entry.queries()["natural_sort_rows"](spark, SMALL).collect()]
    assert len(got) == rows.count() > 100 and got == sorted(got)
