"""All registered queries. Importing the section modules fills the registry."""

from flowkit.catalog import (  # noqa: F401
    compressing, cleaning, deduping, encoding, growing, jobs, reporting, sampling, scoring,
    sourcing, streaming, training,
)
from flowkit.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
