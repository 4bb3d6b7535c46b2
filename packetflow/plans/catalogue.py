"""All core queries by name, and the SQL of those that have one."""

from __future__ import annotations

from packetflow.plans import images, packets, profiles, readings

_MODULES = (packets, readings, images, profiles)

QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
