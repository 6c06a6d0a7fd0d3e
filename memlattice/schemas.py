"""Schemas of the stored tables and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_S, _I, _L, _D, _B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


MEMORY_RECORD = _table(
    id=_S, memory_type=_S, judgment=_S, reasoning=_S, strength=_I, is_active=_B, useful_count=_I, useful_score=_D,
    last_recalled_at=_D, last_decay_at=_D, created_at=_D, updated_at=_D, memory_scope=_S,
)
GLOBAL_TAG = _table(id=_L, name=_S)
MEMORY_TAG = _table(memory_id=_S, tag_id=_L)
NOTE_REGISTRY = _table(source_id=_S, note_short_id=_L, source_file_path=_S, heading=_S, total_lines=_I, updated_at=_D)
NOTE_CHUNK = _table(file_id=_S, source_file_path=_S, chunk_index=_I, line_start=_I, line_end=_I, content=_S)
FILE_INDEX = _table(id=_L, relative_path=_S, file_timestamp=_L)
VECTOR_ROW = _table(item_id=_S, vector_text=_S, embedding=ArrayType(FloatType()), dimension=_I, updated_at=_D)
VECTORS = _table(item_id=_S, vector_text=_S, embedding=ArrayType(FloatType()))
SESSION_REFERENCE = _table(session=_S, id=_S, memory_type=_S, priority=_I, added_at=_D, user_id=_S)
CHAT_RECORD = _table(session=_S, seq=_L, role=_S, content=_S, sender_id=_S, sender_name=_S, ts=_D, is_processed=_B)
MEMORY_ACTION = _table(
    action=_S, source_memory_ids=ArrayType(_S), memory=_table(type=_S, judgment=_S, reasoning=_S, tags=ArrayType(_S))
)
#: One of the file index; another value in a stored index makes it be rebuilt.
FILE_INDEX_VERSION = "note_chunks_md_txt_v1"

# Fixed values of the data model.
MEMORY_TYPES = {"knowledge": "知识记忆", "event": "事件记忆", "skill": "技能记忆", "task": "任务记忆", "emotional": "情感记忆"}
TYPE_LABELS = {"knowledge": "知识", "event": "事件", "skill": "技能", "emotional": "情感", "task": "任务", "meta": "元记忆"}
PROFILE_ATTRIBUTES = ("用户别名", "事实属性", "技能树", "关系图谱", "活跃项目")
PUBLIC = "public"
