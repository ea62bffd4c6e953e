"""From raw records to entities, relationships and members; idempotent sinks and the profile file."""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.runtime import _path

PROFILE_VERSION = 1


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Identity of each file under a path: the SHA-256 of its bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("file_fingerprint"))


def eligible(records: DataFrame) -> DataFrame:
    """Records that become entities: with a global id, and no relationships."""
    return records.where(F.col("global_id").isNotNull() & (F.trim("global_id") != "") & ~F.lower("ifc_class").startswith("ifcrel"))


def scan_report(records: DataFrame) -> DataFrame:
    """Counts of each model: rows, eligible ones, relationships, rows without and with repeated global ids."""
    rel = F.lower("ifc_class").startswith("ifcrel")
    has = F.col("global_id").isNotNull() & (F.trim("global_id") != "")
    repeated = records.where(has).groupBy("source_model_id", "global_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("source_model_id").agg(F.count(F.lit(1)).alias("n_repeated_ids"))
    base = records.groupBy("source_model_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(has & ~rel).alias("n_eligible"), F.count_if(rel).alias("n_relationships"), F.count_if(~has).alias("n_without_id"))
    return base.join(repeated, "source_model_id", "left").na.fill(0, ["n_repeated_ids"])


def safe_scalar(c):
    """Text trimmed; numbers as they are, but NaN and infinities (as numbers or their text) null."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    return F.when(~F.coalesce(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(False)), text)


def explode_members(relationships: DataFrame) -> DataFrame:
    """One row per end of a relationship: listed ends carry their place, single ones none; other shapes are no ends."""
    r = relationships.select(F.col("id").alias("relationship_id"), "source_model_id", F.explode(F.expr("try_variant_get(try_parse_json(canonical_json), '$.endpoints', 'map<string,variant>')")).alias("role", "e"))
    kind = F.schema_of_variant("e")
    listed = r.where(kind.startswith("ARRAY")).select("relationship_id", "source_model_id", "role", F.posexplode(F.try_variant_get("e", "$", "array<variant>")).alias("member_order", "e"))
    single = r.where(kind.startswith("OBJECT")).select("relationship_id", "source_model_id", "role", F.lit(None).cast("int").alias("member_order"), "e")
    both = listed.unionByName(single).where(F.schema_of_variant("e").startswith("OBJECT"))
    get = lambda k, t: F.try_variant_get("e", f"$.{k}", t)
    return both.select(
        "relationship_id", "source_model_id", "role", "member_order",
        get("step_id", "int").alias("endpoint_step_id"), get("ifc_class", "string").alias("endpoint_ifc_class"), get("global_id", "string").alias("endpoint_global_id"), get("name", "string").alias("endpoint_name"),
    )


def resolve_endpoints(members: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id by model and global id, the smallest of re-imports; null where there is none. Never by name."""
    known = entities.groupBy(F.col("source_model_id").alias("k_model"), F.col("global_id").alias("k_gid")).agg(F.min("id").alias("entity_id"))
    m = members.drop("entity_id")
    return m.join(known, (m.source_model_id == F.col("k_model")) & (m.endpoint_global_id == F.col("k_gid")), "left").drop("k_model", "k_gid")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with incoming ones of the same key put in their place; null keys are values."""
    on = [stored[k].eqNullSafe(incoming[k]) for k in keys]
    return stored.join(incoming, on, "left_anti").unionByName(incoming, allowMissingColumns=True)


def write_models(df: DataFrame, path: str) -> None:
    """Writes only the partitions (models) that the rows are of; a second run changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_model_id").parquet(path)


def import_report(prior: DataFrame, now: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    from trellisq.operators.documents import classify_changes

    return classify_changes(prior, now, keys, compare).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def content_hash(document: dict) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def write_profile(profile: dict, path: str, spark: SparkSession | None = None) -> str:
    """A profile as a JSON file with its hash, put in place by a rename. Returns the hash.

    With a session the path is one of its file systems (a shared folder of a cluster), else a local one.
    """
    body = {"version": PROFILE_VERSION, **profile}
    digest = content_hash(body)
    text = json.dumps({**body, "content_hash": digest}, sort_keys=True, ensure_ascii=False)
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    if spark is not None:
        place, fs = _path(spark, path)
        new, _ = _path(spark, tmp)
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        fs.delete(place, False)
        if not fs.rename(new, place):
            raise OSError(f"{path} could not be put in place")
        return digest
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)
    return digest


def read_profile(path: str, model: int | None = None) -> tuple[str, dict | None]:
    """(ready | missing | stale | unavailable, profile): stale is another version or model, unavailable a damaged file."""
    if not os.path.exists(path):
        return "missing", None
    try:
        with open(path, encoding="utf-8") as f:
            body = json.load(f)
        digest = body.pop("content_hash", None)
    except (ValueError, OSError, AttributeError):
        return "unavailable", None
    if digest != content_hash(body):
        return "unavailable", None
    if body.get("version") != PROFILE_VERSION or (model is not None and body.get("source_model_id") != model):
        return "stale", None
    return "ready", body


def _owners(members: DataFrame, relationships: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """(child, owner) entities of relationships of the classes given."""
    rels = relationships.where(F.col("ifc_class").isin(list(classes))).select(F.col("id").alias("relationship_id"))
    m = members.where("entity_id is not null").join(rels, "relationship_id", "left_semi").select("relationship_id", "entity_id", F.lower("role").alias("r"))
    a = m.where("r like 'relating%'").select("relationship_id", F.col("entity_id").alias("owner"))
    return m.where("r like 'related%'").select("relationship_id", F.col("entity_id").alias("child")).join(a, "relationship_id").select("child", "owner").distinct()


def resolve_context(entities: DataFrame, relationships: DataFrame, members: DataFrame, levels: int = 4) -> DataFrame:
    """id with the storey and the type that relationships say: storey_id, storey_name, storey_global_id, type_id, type_name, type_global_id.

    The container is followed upward, through containers and wholes, until a storey is met, ``levels`` steps at most
    (the bound of the spatial structure above an object). Of several owners the smallest counts. The facts are those
    of the owner's record.
    """
    name = F.get_json_object("canonical_json", "$.identity.name")
    known = entities.where("id is not null").select(F.col("id").alias("k"), F.lower("ifc_class").alias("k_class"), name.alias("k_name"), F.col("global_id").alias("k_gid"))
    held = _owners(members, relationships, ("IfcRelContainedInSpatialStructure", "IfcRelAggregates")).groupBy("child").agg(F.min("owner").alias("owner"))
    up = held.join(known, F.col("owner") == F.col("k")).select("child", "owner", "k_class", "k_name", "k_gid")
    at = entities.where("id is not null").select("id", F.col("id").alias("at"), F.lit(None).cast("long").alias("storey_id"), F.lit(None).cast("string").alias("storey_name"), F.lit(None).cast("string").alias("storey_global_id"))
    for _ in range(levels):
        met = F.col("storey_id").isNull() & (F.col("k_class") == "ifcbuildingstorey")
        step = at.join(up, F.col("at") == F.col("child"), "left")
        at = step.select("id", F.when(F.col("storey_id").isNull(), F.col("owner")).alias("at"), *(F.when(met, F.col(k)).otherwise(F.col(c)).alias(c) for c, k in (("storey_id", "owner"), ("storey_name", "k_name"), ("storey_global_id", "k_gid"))))
    typed = _owners(members, relationships, ("IfcRelDefinesByType",)).groupBy("child").agg(F.min("owner").alias("type_id")).join(known, F.col("type_id") == F.col("k"))
    types = typed.select("child", "type_id", F.col("k_name").alias("type_name"), F.col("k_gid").alias("type_global_id"))
    return at.join(types, F.col("id") == F.col("child"), "left").select("id", "storey_id", "storey_name", "storey_global_id", "type_id", "type_name", "type_global_id")


def entity_record(rows: DataFrame) -> DataFrame:
    """id and canonical_json of flat rows in sections: meta, identity, storey, type, placement; absent facts give no key, an absent section none.

    Reads the columns that are there of ifc_class, global_id, step_id, predefined_type, name, description, object_type,
    tag, long_name, storey_name, storey_global_id, type_name, type_global_id, elevation. Numbers that are not finite
    are left out and named in warnings; no row fails.
    """
    have = set(rows.columns)
    col = lambda c: safe_scalar(F.col(c)) if c in have else F.lit(None).cast("string")
    section = lambda **keys: F.nullif(F.to_json(F.struct(*(col(c).alias(k) for k, c in keys.items()))), F.lit("{}"))
    parts = {
        "meta": section(ifc_class="ifc_class", global_id="global_id", predefined_type="predefined_type"),
        "identity": section(name="name", description="description", object_type="object_type", tag="tag", long_name="long_name"),
        "storey": section(name="storey_name", global_id="storey_global_id"),
        "type": section(name="type_name", global_id="type_global_id"),
        "placement": section(elevation="elevation"),
    }
    bad = F.array(*(F.when(F.col(c).isNotNull() & col(c).isNull(), F.lit(f"{c} is no finite number")) for c in sorted(have & {"elevation"})))
    body = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), F.lit("}"))
    return rows.select("id", body.alias("canonical_json"), F.filter(bad.cast("array<string>"), lambda x: x.isNotNull()).alias("warnings"))


def relationship_record(relationships: DataFrame, members: DataFrame) -> DataFrame:
    """id and canonical_json of relationships: meta, identity, and endpoints by role, single ends as objects and listed ones as arrays."""
    end = F.struct(F.col("endpoint_step_id").alias("step_id"), F.col("endpoint_ifc_class").alias("ifc_class"), F.col("endpoint_global_id").alias("global_id"), F.col("endpoint_name").alias("name"))
    m = members.where("role is not null and relationship_id is not null").groupBy("relationship_id", "role").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("member_order", F.lit(-1)).alias("o"), "id", end.alias("e")))).alias("ends"))
    text = F.when((F.size("ends") == 1) & (F.col("ends")[0]["o"] < 0), F.to_json(F.col("ends")[0]["e"])).otherwise(F.to_json(F.transform("ends", lambda x: x["e"])))
    by = m.groupBy("relationship_id").agg(F.array_sort(F.collect_list(F.concat(F.to_json(F.array("role")).substr(F.lit(2), F.length(F.to_json(F.array("role"))) - 2), F.lit(":"), text))).alias("roles"))
    r = relationships.join(by, F.col("id") == F.col("relationship_id"), "left")
    meta = F.to_json(F.struct("ifc_class", "global_id"))
    identity = F.to_json(F.struct("name", "description"))
    body = F.concat(F.lit('{"meta":'), meta, F.lit(',"identity":'), identity, F.lit(',"endpoints":{'), F.array_join(F.coalesce("roles", F.array().cast("array<string>")), ","), F.lit("}}"))
    return r.select("id", body.alias("canonical_json"))


#: What identifies a description. Fixed values.
DOCUMENT_KEY = ["entity_id", "relationship_id", "document_type", "text_template_version", "embedding_model"]


def upsert_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Descriptions with the incoming ones in place of those of the same five-part key; of repeated incoming ones the last made counts."""
    from pyspark.sql import Window

    w = Window.partitionBy(*DOCUMENT_KEY).orderBy(F.col("generation_timestamp").desc_nulls_last(), F.desc("id"))
    return upsert(stored, incoming.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth"), DOCUMENT_KEY)


def pending(ledger: DataFrame, steps: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(version, body, checksum) of the steps still to apply, in order; a step that was applied with another body is an error."""
    done = {r.version: r.checksum for r in ledger.select("version", "checksum").collect()}  # one row a step
    out = []
    for version, body in steps:
        digest = hashlib.sha256(body.encode()).hexdigest()
        if version not in done:
            out.append((version, body, digest))
        elif done[version] != digest:
            raise ValueError(f"step {version} was applied with another body")
    return out


def apply_pending(spark: SparkSession, ledger: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Runs the pending steps as SQL and gives the ledger with their rows added."""
    rows = []
    for version, body, digest in pending(ledger, steps):
        spark.sql(body)
        rows.append((version, digest))
    added = spark.createDataFrame(rows, "version string, checksum string").withColumn("applied_at", F.current_timestamp())
    return ledger.select("version", "checksum", "applied_at").unionByName(added)


CASE = "question string, expected_scope string, expected_route string, expected_answer_type string, relevant_canonical_ids array<long>, expected_exact_count long, required_relationship_classes array<string>, notes string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; a line that is none is an error, a missing file too."""
    rows = spark.read.schema(CASE).option("mode", "FAILFAST").json(path)
    return rows.select("*", F.coalesce("relevant_canonical_ids", F.array().cast("array<long>")).alias("ids")).drop("relevant_canonical_ids").withColumnRenamed("ids", "relevant_canonical_ids")


def seed_catalog(models: DataFrame, entries: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(families, entries) to add for models without an entry: the file's stem names both, version v1, current."""
    stem = F.regexp_replace(F.regexp_replace("file_name", r"^.*[/\\]", ""), r"(?<=.)\.[^.]*\z", "")
    new = models.where("id is not null and file_name is not null").join(entries.select(F.col("source_model_id").alias("id")), "id", "left_anti").select(F.col("id").alias("source_model_id"), stem.alias("display_name"))
    new = new.withColumn("family_key", F.regexp_replace(F.lower("display_name"), " ", "_"))
    known = families.select("family_key").where("family_key is not null")
    fams = new.join(known, "family_key", "left_anti").groupBy("family_key").agg(F.min("display_name").alias("display_name"))
    return fams, new.select("source_model_id", "family_key", "display_name", F.lit("v1").alias("version_label"), F.lit(1).alias("version_order"), F.lit(True).alias("is_current"), F.lit("available").alias("status"))


def read_only(sql: str) -> str:
    """The statement, if it only reads; else an error."""
    words = re.findall(r"[a-z]+", re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", sql.lower(), flags=re.S))
    if not words or words[0] not in ("select", "with", "values", "table", "show", "describe", "explain") or set(words) & {"insert", "merge", "delete", "update", "drop", "create", "alter", "truncate", "overwrite", "refresh", "cache", "set"}:
        raise ValueError("only statements that read are allowed")
    return sql


def within_time(spark: SparkSession, seconds: float, work):
    """What work() gives; its jobs are cancelled after the given time, which raises TimeoutError."""
    tag, late = f"trellisq-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
