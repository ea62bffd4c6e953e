"""Vector search of single queries inside a scope, and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.model import PlanError

DEFAULT_K, MAX_K = 30, 100
THRESHOLDS = {"broad": 0.50, "strict": 0.55}
RRF_K = 60
EXCERPT = 300


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for zero or null vectors."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: (x.cast("double") / norm).cast("float")))


def invalid_vectors(rows: DataFrame, dim: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector can't be used, with the reason."""
    v = F.col(vector_col)
    bad = F.when(v.isNull(), "null").when(F.size(v) != dim, "length").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(F.forall(v, lambda x: x == 0), "zero")
    return rows.select(F.col(id_col), bad.alias("reason")).where("reason is not null")


def check_compatible(rows: DataFrame, model: str, dim: int) -> None:
    """Stored vectors of another model or dimension are an error; none at all are not."""
    other = rows.where(F.col("embedding").isNotNull()).select("embedding_model", "embedding_dim").distinct().where((F.col("embedding_model") != model) | (F.col("embedding_dim") != dim)).take(1)
    if other:
        raise PlanError(f"stored vectors are of {other[0][0]} ({other[0][1]}), the query of {model} ({dim})")


def search(rows: DataFrame, query: list[float], k: int = DEFAULT_K, threshold: float | None = None, scope: DataFrame | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """id, similarity, rank and accepted of the k nearest rows of the scope; ties by id.

    scope None is everything, an empty scope nothing. The order by and limit run as a top-k per task.
    """
    if not 1 <= k <= MAX_K:
        raise PlanError(f"k from 1 to {MAX_K}")
    inside = rows if scope is None else rows.join(scope.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = inside.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("similarity")).where("similarity is not null")
    top = scored.orderBy(F.desc("similarity"), "id").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))  # k rows
    return ranked.withColumn("accepted", F.col("similarity") >= threshold if threshold is not None else F.lit(True))


def fuse(lists: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion over (kind, id); ties go to the kind named first, then to the better rank."""
    parts = None
    for order, (kind, df) in enumerate(lists.items()):
        part = df.select(F.lit(kind).alias("kind"), F.lit(order).alias("kind_order"), "id", "rank")
        parts = part if parts is None else parts.unionByName(part)
    score = parts.groupBy("kind", "kind_order", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))
    return score.orderBy(F.desc("score"), "kind_order", "best_rank", "id").drop("kind_order")


def excerpts(rows: DataFrame, documents: DataFrame) -> DataFrame:
    return rows.join(documents.select("id", F.substring("document_text", 1, EXCERPT).alias("excerpt")), "id")


def precision_recall(found: Column, relevant: Column) -> tuple[Column, Column]:
    """Of two arrays of ids; null where the denominator is empty."""
    hits = F.size(F.array_intersect(found, relevant))
    return hits / F.nullif(F.size(F.array_distinct(found)), F.lit(0)), hits / F.nullif(F.size(F.array_distinct(relevant)), F.lit(0))
