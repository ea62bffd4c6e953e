"""All query registries of the core."""

from __future__ import annotations


def collect() -> list[tuple[dict, dict]]:
    from trellisq.plans import answers, problems, retrieval, structure, typed

    return [(m.QUERIES, m.ORACLES) for m in (typed, structure, retrieval, answers, problems)]
