"""Fixed schemas of the code graph's tables.

Order matters to several operators, and Spark keeps none, so it is data: ``seq`` columns
rank rows in the order in which they were found.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I, _L, _B, _T = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()

TRIPLES = _struct(
    seq=_L, from_entity=_S, from_type=_S, relation_type=_S, to_entity=_S, to_type=_S, source_file=_S, line_number=_I,
    call_receiver=_S, call_receiver_type=_S, is_exported=_B, owner_class=_S,
)
NODES = _struct(
    id=_S, type=_S, name=_S, path=_S, project=_S, extension=_S, depth=_I, entity_type=_S, language=_S, kind=_S, file=_S, line=_I, owner=_S,
    is_exported=_B, description=_S, agent_inferred=_B, agent_created=_B, last_ingested=_T, updated_at=_T, node_seq=_L,
)
EDGES = _struct(
    src=_S, dst=_S, type=_S, source_file=_S, line=_I, receiver=_S, receiver_type=_S, resolved=_B, agent_inferred=_B, agent_relation=_B,
    created_at=_T, edge_seq=_L,
)
RESOLVED = T.StructType([*TRIPLES, T.StructField("from_id", _S), T.StructField("to_id", _S)])
#: Where the rows of each file begin in the order of all, and how many they are.
PLACES = _struct(path=_S, begin=_L, n=_L)
EVENTS = _struct(event_id=_L, ts=_T, kind=_S, path=_S, dest_path=_S)

#: The relations that extraction may write; any other becomes RELATION.
RELATIONS = ("CALLS", "IMPORTS", "INHERITS", "DEFINED_IN", "HAS_CLASS", "POSTS_TO", "INCLUDES", "STYLES", "USED_BY", "USES_VAR", "REFERENCES")
#: Language by file extension.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "html": "html", "css": "css", "scss": "scss", "php": "php",
}
