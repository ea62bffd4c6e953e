"""The surface of the engine as plain functions over a folder of tables: what a server would route requests to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trellisq.model import PlanError
from trellisq.operators import catalog as C
from trellisq.operators import entities as E
from trellisq.operators import graph as G
from trellisq.operators import viewer as W
from trellisq.plans import binding as B
from trellisq.sources import TABLES, table
from trellisq.sources.ingest import within_time

TIMEOUT = 5.0


@dataclass(frozen=True)
class Engine:
    spark: SparkSession
    data: str

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.data, name)

    def _catalog(self) -> DataFrame:
        return C.catalog(self._t("ifc_source_models"), self._t("source_model_catalog_entries"), self._t("model_families"))

    def health(self) -> dict:
        return {"status": "ok"}

    def ready(self) -> dict:
        """Whether every table of the model can be read, and which can't."""
        missing = []
        for name in TABLES:
            try:
                self._t(name).schema  # noqa: B018
            except Exception:  # noqa: BLE001 - whatever keeps a table from being read makes the engine not ready
                missing.append(name)
        return {"ready": not missing, "missing": missing}

    def models(self) -> DataFrame:
        return C.selector_models(self._catalog())

    def model(self, model: int) -> DataFrame:
        return C.metadata(self._catalog(), model)

    def context(self, model: int, **more) -> B.Context:
        C.metadata(self._catalog(), model)
        return B.Context(model, self._t("ifc_entities"), self._t("ifc_relationships"), self._t("relationship_members"), self._t("rag_documents"), **more)

    def floors(self, model: int) -> DataFrame:
        return B.floors(self.context(model))

    def resolve(self, model: int, global_ids: list[str | None]) -> DataFrame:
        return E.resolve_selection(self._t("ifc_entities"), model, global_ids)

    def details(self, model: int, global_id: str) -> tuple[DataFrame, DataFrame]:
        """(facts, display rows) of one object."""
        one = E.get_entity(self._t("ifc_entities"), model, global_id=global_id)
        if not one.take(1):
            raise PlanError(f"no object {global_id} in model {model}")
        return W.object_facts(one), E.details(self._t("ifc_entities"), model, global_id)

    def highlight(self, part: B.Part, model: int) -> DataFrame:
        return B.viewer(part, self.context(model))

    def relationship(self, model: int, relationship_id: int) -> tuple[DataFrame, DataFrame]:
        rels = self._t("ifc_relationships")
        return G.get_relationship(rels, model, relationship_id), G.relationship_members(self._t("relationship_members"), relationship_id, rels)

    def query(self, parts: list[B.Part], model: int, seconds: float | None = None, **more) -> list[B.Result]:
        """The results of bound parts in their order; invalid ones are refused, late ones stopped."""
        if problems := B.validate(parts):
            raise PlanError("; ".join(problems))
        ctx = self.context(model, **more)
        work = lambda: [B.execute(p, ctx) for p in parts]
        return within_time(self.spark, seconds, work) if seconds else work()
