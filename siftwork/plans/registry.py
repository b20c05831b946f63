"""Queries over the driver's tables and their SQL twins, gathered from the modules beside this one."""

from __future__ import annotations

from . import closed, forms, inputs, models, observation, probes, relational, release, robustness, scene, state, steps, wire

MODULES = (probes, relational, forms, release, scene, observation, wire, models, inputs, robustness, closed, steps, state)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: f for m in MODULES for k, f in m.ORACLES.items()}
