"""The domain's tables as views over the generic test tables, stated once for both engines.

Every expression below is SQL that Spark and DuckDB read alike; ``{arr}`` is the list constructor of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.session import load

NOW = 1710000000.0

_TYPE = "case doc_id % 5 when 0 then '知识记忆' when 1 then '事件记忆' when 2 then '技能记忆' when 3 then '任务记忆' else '情感记忆' end"
MEM = {
    "id": "'m' || cast(doc_id as string)",
    "memory_type": _TYPE,
    "judgment": "coalesce(text, '')",
    "reasoning": "'noted in ' || coalesce(source, 'none') || ' as ' || coalesce(lang, 'xx')",
    "strength": "cast(doc_id % 12 as int)",
    "is_active": "doc_id % 7 = 0",
    "useful_count": "cast(coalesce(quality, 0) as int)",
    "useful_score": "cast((doc_id % 6) * 2.5 as double)",
    "last_recalled_at": "case when doc_id % 4 = 0 then cast(0 as double) else cast(1700000000 + doc_id * 3600 + (doc_id % 5) * 86400 as double) end",
    "last_decay_at": "case when doc_id % 3 = 0 then cast(1700043200 + doc_id * 3600 as double) else cast(0 as double) end",
    "created_at": "cast(1700000000 + doc_id * 3600 as double)",
    "updated_at": "cast(1700000000 + doc_id * 3600 + (doc_id % 11) * 60 as double)",
    "memory_scope": "case doc_id % 3 when 0 then 'public' when 1 then 'a' else 'b' end",
    "tags": "{arr}(coalesce(lang, 'xx'), coalesce(source, 'none'), case when n_chars < 1000 then 'short' when n_chars < 5000 then 'medium' else 'long' end)",
}
PROFILE = {
    "id": "'o' || cast(o_orderkey as string)",
    "memory_type": "'知识记忆'",
    "judgment": "'order of ' || cast(o_custkey as string)",
    "strength": "cast(o_orderkey % 9 as int)",
    "is_active": "o_orderstatus = 'O'",
    "updated_at": "cast(o_orderkey % 1000 as double)",
    "memory_scope": "case o_orderkey % 3 when 0 then 'public' when 1 then 'a' else 'b' end",
    "tags": "{arr}(lpad(cast(o_custkey as string), 9, '0'), case o_orderkey % 6 when 0 then '用户别名' when 1 then '事实属性' when 2 then '技能树' when 3 then '关系图谱' when 4 then '活跃项目' else 'other' end, substr(o_orderpriority, 3, 3))",
}
CHAT = {
    "session": "cast(conv_id as string)",
    "seq": "cast(turn as bigint)",
    "role": "role",
    "content": "text",
    "sender_id": "case when role = 'user' and conv_id % 9 <> 0 then cast(100000 + conv_id % 40 as string) else '' end",
    "sender_name": "case when role = 'user' and turn % 3 <> 2 then 'name' || cast(turn % 4 as string) else '' end",
    "ts": "cast(1700000000 + conv_id * 5000 + turn * 60 + floor(turn / 4) * 700 as double)",
    "is_processed": "turn % 3 = 0",
}
NOTE = {
    "file_id": "coalesce(source, 'none') || '/' || cast(doc_id as string) || '.md'",
    "source_file_path": "coalesce(source, 'none') || '/' || cast(doc_id as string) || '.md'",
    "content": "coalesce(text, '')",
}
INDEX = {"relative_path": "case when page_id % 6 = 1 then 'gone' else 'p' end || cast(page_id as string) || '.md'", "file_timestamp": "cast(1000 + page_id as bigint)"}
DISK = {"relative_path": "case when page_id % 7 = 3 then 'live' else 'p' end || cast(page_id as string) || '.md'", "file_timestamp": "cast(1000 + page_id + case when page_id % 5 = 0 then 50 when page_id % 5 = 1 then -5 else 0 end as bigint)"}


def _spark(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(v.replace("{arr}", "array")).alias(k) for k, v in cols.items()])


def _duck(name: str, cols: dict[str, str], source: str) -> str:
    return f"{name} as (select " + ", ".join(f"{v.replace('{arr}', 'list_value')} as {k}" for k, v in cols.items()) + f" from {source})"


def memories(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "labels").select("doc_id", "quality")
    return _spark(load(spark, d, "documents").join(labels, "doc_id", "left"), MEM)


def profile_memories(spark: SparkSession, d: str) -> DataFrame:
    return _spark(load(spark, d, "orders"), PROFILE)


def chat(spark: SparkSession, d: str) -> DataFrame:
    return _spark(load(spark, d, "conversations"), CHAT)


def notes(spark: SparkSession, d: str) -> DataFrame:
    return _spark(load(spark, d, "documents"), NOTE)


def file_index(spark: SparkSession, d: str) -> DataFrame:
    return _spark(load(spark, d, "pages"), INDEX)


def disk_files(spark: SparkSession, d: str) -> DataFrame:
    return _spark(load(spark, d, "pages"), DISK)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id")).alias("id"), "vec_id", "embedding")


SQL = {
    "mem": _duck("mem", MEM, "documents left join labels using (doc_id)"),
    "prof": _duck("prof", PROFILE, "orders"),
    "chat": _duck("chat", CHAT, "conversations"),
    "note": _duck("note", NOTE, "documents"),
    "idx": _duck("idx", INDEX, "pages"),
    "disk": _duck("disk", DISK, "pages"),
    "dim": "dim as (select row_number() over (order by name) as id, name from (select distinct unnest(tags) as name from mem))",
    "rel": "rel as (select distinct m.id as memory_id, dim.id as tag_id from (select id, unnest(tags) as name from mem) m join dim using (name))",
}


def sql(*names: str) -> str:
    """WITH clause of the named views."""
    return "with " + ",\n".join(SQL[n] for n in names)
