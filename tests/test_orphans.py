import datetime as dt

from trellisq.operators.orphans import orphan_counts, orphan_references

T = [dt.datetime(2024, m, 1) for m in range(1, 13)]
MEMBER = "id long, relationship_id long, source_model_id int, entity_id long, endpoint_global_id string, endpoint_step_id int, key string, state string"
REL = "id long, import_timestamp timestamp_ntz, key string"
ENT = "id long, source_model_id int, global_id string, step_id int, import_timestamp timestamp_ntz, ref_field string"


def test_each_case(spark):
    entities = spark.createDataFrame(
        [(1, 1, "A", 10, T[0], "x"), (2, 1, "B", 20, T[5], "x"), (3, 1, "C", None, T[7], "x"), (4, 1, "C", 30, T[2], "x"), (5, 1, None, 50, None, "x"), (6, None, "N", 60, T[0], "x")], ENT
    )
    rels = spark.createDataFrame([(1, T[3], "x"), (2, None, "x")], REL)
    members = spark.createDataFrame(
        [
            (1, 1, 1, 1, "A", 10, "k", "s"),  # all there
            (2, 1, 1, 9, "Z", 99, "k", "s"),  # all missing
            (3, 1, 1, 2, "B", 20, "k", "s"),  # all late
            (4, 1, 1, 3, "C", 30, "k", "s"),  # late by id, but the re-import of C was early
            (5, 1, 1, None, None, 77, "k", "s"),  # a step without a global id is no reference
            (6, 1, 2, 1, "A", 10, "k", "s"),  # another model
            (7, 2, 1, 2, "B", None, "k", "s"),  # no time of the relationship: never late
            (8, 9, 1, 2, "a", None, "k", "s"),  # no such relationship; compared exactly
            (9, 1, None, 6, "N", None, "k", "s"),  # no model: no match
            (10, 1, 1, 5, None, None, "k", "s"),  # a parent without a time is not late
            (11, 1, 1, 9, "Z", 99, "k", "s"),  # a repeated row counts again
            (12, None, None, None, None, None, "k", "s"),
        ],
        MEMBER,
    )
    got = {(r.member_id, r.ref_field, r.state) for r in orphan_references(members, rels, entities).collect()}
    all3 = ("entity_id", "endpoint_global_id", "endpoint_step_id")
    want = {(m, f, s) for m, s in ((2, "missing"), (3, "late"), (6, "missing"), (11, "missing")) for f in all3}
    want |= {(4, "entity_id", "late"), (8, "endpoint_global_id", "missing"), (9, "entity_id", "missing"), (9, "endpoint_global_id", "missing")}
    assert got == want
    counts = {(r.ref_field, r.state, r.month): r.n for r in orphan_counts(orphan_references(members, rels, entities)).collect()}
    assert counts["entity_id", "missing", "2024-04"] == 4 and counts["endpoint_global_id", "missing", None] == 1
    none = members.where("false")
    assert orphan_references(none, rels, entities).count() == 0
    assert orphan_references(members, rels, entities.where("false")).where("state = 'late'").count() == 0
