"""Connected components of a link table, over the tables of one run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.llm.common import Scratch
from tidemark.operators import graph


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(v, component) for every vertex of ``edges`` (longs a, b); component is its smallest vertex."""
    return graph.components(edges, scratch.write, name)
