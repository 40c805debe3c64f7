"""All registered queries of the reference's own operators."""

from engram.plans import clauses, feeds, governance, lifecycle, retrieval, sources, streams, telemetry, text  # noqa: F401
from engram.plans.registry import QUERIES, SQL  # noqa: F401
