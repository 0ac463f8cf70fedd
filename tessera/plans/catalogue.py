"""All queries of the library over the driver tables, by name, with their SQL."""

from __future__ import annotations

from tessera.plans import answers, discovery, graph, groups, matching, publication, scalars, sources, streams, structural, tracker
from tessera.plans.registry import QUERIES, SQL

FLAGSHIP = graph.FLAGSHIP

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "answers", "discovery", "groups", "matching", "publication", "scalars", "sources", "streams", "structural", "tracker"]
