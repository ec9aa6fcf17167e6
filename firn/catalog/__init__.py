"""All registered jobs; importing the package registers them."""

from firn.catalog import (
    aggregates, cleaning, joins, models, rules, scans, texts, whatif, windows,
)
from firn.catalog.registry import CHECKS, JOBS

FAMILIES = (scans, cleaning, joins, aggregates, windows, rules, texts, whatif, models)

__all__ = ["CHECKS", "FAMILIES", "JOBS"]
