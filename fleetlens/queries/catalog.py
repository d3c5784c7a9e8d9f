"""Importing this module registers every query."""

from fleetlens.queries import panels, relational, scalars, temporal  # noqa: F401

FLAGSHIP = "pl_3"
