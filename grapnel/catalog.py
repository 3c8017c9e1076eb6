"""All queries of the library and the SQL they are checked against."""

from __future__ import annotations

from grapnel.operators import answers, documents, extraction, linkage, relational, repair, retrieval, store, structure, textops, traversal  # noqa: F401
from grapnel.plans import graph_views  # noqa: F401
from grapnel.registry import ORACLES, QUERIES  # noqa: F401
from grapnel.sources import connectors  # noqa: F401
from grapnel.streaming import progress  # noqa: F401
