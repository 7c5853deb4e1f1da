"""Columns of a graph's tables, its enumerations, and the constants of building and searching it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KINDS: dict[str, T.DataType] = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "time": T.TimestampType(),
    "list": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split(":") for c in columns.split())])


NODES = _schema(
    "node_id:string ord:long file:string section:string type:string content:string content_hash:string entities:list links:list parent:string "
    "metadata:map level:int confidence:double created_at:time last_accessed_at:time access_count:long valid_until:time"
)
DIRECTED = _schema("src:string dst:string type:string weight:double evidence:string ord:long")
UNDIRECTED = _schema("a:string b:string type:string weight:double ord:long")

STRUCTURAL = ("document", "section")
NODE_TYPES = (
    *STRUCTURAL, "fact", "concept", "entity", "event", "definition", "claim", "data-point", "person", "organization", "conversation",
    "message", "preference", "image", "video", "transcript", "visual-description", "session-summary",
)
DIRECTED_TYPES = (
    "precedes", "contains", "cites", "defines", "causes", "depends-on", "supports", "contradicts", "supersedes", "summarizes",
    "discussed-in", "knows", "works-with", "reports-to", "collaborated-on", "prefers",
)
UNDIRECTED_TYPES = ("similar-to", "shares-entity", "shares-topic", "co-occurs", "same-source", "same-person", "related-to")

SIMILAR, SHARED = 0.3, 0.2
MAX_DF, CANDIDATES, DEGREE = 500, 50, 10
HOPS, DECAY, BACKWARD, TOP_NODES, SEEDS = 3, 0.6, 0.5, 20, 5
CONFIDENCE = 0.9
#: Bits of a node's ord that number it within its document.
PLACE_BITS = 24


@dataclass(frozen=True)
class Graph:
    """One node set with two edge sets, and the index over it."""

    nodes: DataFrame
    dedges: DataFrame
    uedges: DataFrame
    postings: DataFrame | None = None
    idf: DataFrame | None = None
    embeddings: DataFrame | None = None
    analyzer: str = "ascii-fold"
    embedder: str | None = None
    version: int = 1

    def having(self, **changes: object) -> Graph:
        return replace(self, **changes)
