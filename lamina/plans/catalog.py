"""All registered queries: importing this module registers them."""

from lamina.plans import engine, images, inks, races, textlayers, texts
from lamina.plans.registry import QUERIES, SQL

MODULES = (images, engine, inks, races, textlayers, texts)
__all__ = ["MODULES", "QUERIES", "SQL"]
