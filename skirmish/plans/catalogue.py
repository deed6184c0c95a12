"""All queries of the contest engine. Importing the modules registers them."""

from __future__ import annotations

from skirmish.plans import audits, codecs, draft, evaluations, evidence, explain, inference, matching, meetings, models, normalise, rates, readmodels, records, sequences, stacking, transition
from skirmish.plans.registry import ORACLES, QUERIES

MODULES = (audits, codecs, draft, evaluations, evidence, explain, inference, matching, meetings, models, normalise, rates, readmodels, records, sequences, stacking, transition)


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(ORACLES)
