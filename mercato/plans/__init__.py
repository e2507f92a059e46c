"""The query catalogue: named queries over a data directory."""

from mercato.plans.catalog import QUERIES, query  # noqa: F401
from mercato.plans.context import Context  # noqa: F401
