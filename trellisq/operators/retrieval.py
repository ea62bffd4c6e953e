"""Retrieval over stored documents: search of each kind, fusion, acceptance, hydration and what stands in without vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.model import PlanError
from trellisq.operators import entities as E
from trellisq.operators import vectors as V

KINDS = ("entity", "relationship")
MAX_SELECTED = 5
POOL = 4
FALLBACK_ROWS = 15
EMPTY_SCOPE = "the scope holds no objects, so nothing was ranked; that is no miss of the search"
NOT_SUFFICIENT = "no document is similar enough"


@dataclass
class Found:
    """Candidates of both kinds (kind, id, document_id, similarity, rank, accepted), their fusion if both were asked for, and warnings."""

    candidates: DataFrame
    fused: DataFrame | None
    warnings: tuple[str, ...]


def documents_of(documents: DataFrame, model: int, kind: str, embedding_model: str | None = None) -> DataFrame:
    """The documents of one kind, with the id of what they describe as ``id``; the vectors of one embedding model only."""
    if kind not in KINDS:
        raise PlanError(f"no documents of kind {kind}")
    rows = documents.where((F.col("source_model_id") == model) & (F.col("source_kind") == kind))
    if embedding_model is not None:
        rows = rows.where(F.col("embedding_model") == embedding_model)
    return rows.select(F.col("id").alias("document_id"), F.col(f"{kind}_id").alias("id"), "embedding", "document_text")


def search_kind(documents: DataFrame, model: int, kind: str, query: list[float], k: int, threshold: float, embedding_model: str | None = None, scope: DataFrame | None = None) -> DataFrame:
    """kind, id, document_id, similarity, rank and accepted of the k nearest documents of a kind; ties by document.

    A description that was made twice is two documents; each has its rank.
    """
    rows = documents_of(documents, model, kind, embedding_model).where("id is not null")
    if scope is not None:
        rows = rows.join(scope.select("id").distinct(), "id", "left_semi")
    owner = rows.select(F.col("document_id").alias("d"), "id")
    top = V.search(rows.drop("id"), query, k, threshold, id_col="document_id").withColumnRenamed("id", "document_id")
    return top.join(owner, F.col("document_id") == F.col("d")).select(F.lit(kind).alias("kind"), "id", "document_id", "similarity", "rank", "accepted")


def rag_search(documents: DataFrame, model: int, query: list[float], kinds: tuple[str, ...] = KINDS, k: int = V.DEFAULT_K, profile: str = "broad", embedding_model: str | None = None, scope: DataFrame | None = None) -> Found:
    """One query vector, each kind searched on its own, fused only if both were. A scope is of entities.

    An empty scope and a search without an accepted document are told apart by their warnings.
    """
    if profile not in V.THRESHOLDS or not kinds:
        raise PlanError("a known threshold profile and at least one kind")
    lists = {kind: search_kind(documents, model, kind, query, k, V.THRESHOLDS[profile], embedding_model, scope if kind == "entity" else None) for kind in KINDS if kind in kinds}
    both = None
    for one in lists.values():
        both = one if both is None else both.unionByName(one)
    fused = V.fuse(lists) if len(lists) == len(KINDS) else None
    if scope is not None and not scope.take(1):
        warnings: tuple[str, ...] = (EMPTY_SCOPE,)
    else:
        warnings = () if both.where("accepted").take(1) else (NOT_SUFFICIENT,)
    return Found(both, fused, warnings)


def hydrate(candidates: DataFrame, entities: DataFrame, relationships: DataFrame, members: DataFrame, model: int, expand_endpoints: bool = True) -> DataFrame:
    """part (primary, relationship, context), id, global_id, ifc_class and name of what accepted candidates mean.

    With expand_endpoints the resolved ends of accepted relationships are context, unless they are primary already.
    """
    accepted = candidates.where("accepted").select("kind", "id").distinct()
    ids = lambda kind: accepted.where(F.col("kind") == kind).select("id")
    known = E.hydrate(entities.where(F.col("source_model_id") == model)).select("id", "global_id", "ifc_class", "name")
    primary = known.join(ids("entity"), "id", "left_semi").withColumn("part", F.lit("primary"))
    rels = relationships.where(F.col("source_model_id") == model).join(ids("relationship"), "id", "left_semi").select("id", "global_id", "ifc_class", "name")
    out = primary.unionByName(rels.withColumn("part", F.lit("relationship")))
    if expand_endpoints:
        ends = members.where("entity_id is not null").join(rels.select(F.col("id").alias("relationship_id")), "relationship_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
        context = known.join(ends, "id", "left_semi").join(ids("entity"), "id", "left_anti")
        out = out.unionByName(context.withColumn("part", F.lit("context")))
    return out.select("part", "id", "global_id", "ifc_class", "name")


def selected_summaries(entities: DataFrame, model: int, ids: list[int]) -> DataFrame:
    """Summaries of at most five selected entities, in the order of selection; unknown ids are left out."""
    if len(ids) > MAX_SELECTED:
        raise PlanError(f"at most {MAX_SELECTED} selected entities")
    order = {v: i for i, v in reversed(list(enumerate(ids)))}
    rows = E.hydrate(entities.where((F.col("source_model_id") == model) & F.col("id").isin(list(order))))
    if not order:
        return rows.where(F.lit(False)).withColumn("pos", F.lit(0))
    place = F.create_map(*(F.lit(x).cast("long") if i % 2 == 0 else F.lit(x) for kv in order.items() for i, x in enumerate(kv)))
    return rows.withColumn("pos", place[F.col("id").cast("long")]).orderBy("pos")


def lexical_fallback(question: str, class_counts: DataFrame, limit: int = FALLBACK_ROWS) -> DataFrame:
    """ifc_class, n and matched without any vector: classes whose name, without its prefix, is in the question come first, then by count."""
    stem = F.regexp_replace(F.lower("ifc_class"), "^ifc", "")
    matched = F.coalesce((stem != "") & F.contains(F.lit(question.lower()), stem), F.lit(False))
    return class_counts.where("ifc_class is not null").select("ifc_class", "n", matched.alias("matched")).orderBy(F.desc("matched"), F.desc("n"), "ifc_class").limit(limit)


def semantic_resolution(query: list[float], candidates: DataFrame, k: int, present: DataFrame) -> DataFrame:
    """kind, name, similarity, n and rank of the k concepts nearest to a query vector, of each kind.

    candidates: kind, name, embedding; present: name, n. A pool four times as large is ranked first, a name that
    occurs more than once counts with its best vector, and concepts that the model has come before those it lacks.
    """
    from pyspark.sql import Window

    q = F.array(*(F.lit(float(x)) for x in query))
    scored = candidates.where(F.size("embedding") == len(query)).select("kind", "name", V.cosine(F.col("embedding"), q).alias("similarity")).where("similarity is not null")
    best = scored.groupBy("kind", "name").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("kind").orderBy(F.desc("similarity"), "name")
    pool = best.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= POOL * k)
    known = pool.join(present.select("name", "n"), "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("kind").orderBy(F.desc(F.col("n") > 0), F.desc("similarity"), "name")
    return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("kind", "name", "similarity", "n", "rank")
