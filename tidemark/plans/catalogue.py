"""All queries of the core; importing the modules registers them."""

from tidemark.plans import evidence, evolution, gates, graphs, intake, relational, shapes, texts  # noqa: F401
from tidemark.plans.registry import ORACLE, QUERIES  # noqa: F401
