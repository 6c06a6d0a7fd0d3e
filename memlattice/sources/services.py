"""Adapters for outside services (embedding, chat hosts)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.functions.text import content_text


class TooLarge(Exception):
    """A service's answer to a request with too much in it."""


def embed_all(call: Callable[[list[str]], list], texts: list[str], size: int = 64) -> list:
    """Vectors of all texts, asked for in batches; a batch that is too large is halved.

    An answer with one vector for a batch of several texts is asked for again text by text; any other wrong count is an error.
    """
    out: list = []
    todo = [texts[i : i + size] for i in range(0, len(texts), size)][::-1]
    while todo:
        batch = todo.pop()
        try:
            got = call(batch)
        except TooLarge:
            if len(batch) == 1:
                raise
            half = len(batch) // 2
            todo += [batch[half:], batch[:half]]
            continue
        if len(got) == 1 < len(batch):
            todo += [[t] for t in reversed(batch)]
        elif len(got) != len(batch):
            raise ValueError(f"{len(got)} vectors for {len(batch)} texts")
        else:
            out += got
    return out


def embedder(make: Callable[[], Callable[[list[str]], list]], size: int = 64) -> Callable[[Column], Column]:
    """A column function over a service; ``make`` builds its client, once a task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = make()
        for s in batches:
            yield pd.Series(embed_all(call, [t or "" for t in s], size))

    return run


def in_model_space(index: DataFrame, model: str, dimension: int) -> DataFrame:
    """The vector index (with model), empty of vectors of another model or dimension."""
    return index.filter((F.col("model") == model) & (F.size("embedding") == dimension))


def host_records(raw: DataFrame) -> DataFrame:
    """Chat records out of a host's JSON (session, value): an array of messages whose content is text or a list of parts."""
    kind = "array<struct<role:string,content:string,sender_id:string,sender_name:string,timestamp:double,is_processed:boolean>>"
    rows = raw.select("session", F.posexplode(F.from_json("value", kind)).alias("seq", "m"))
    return rows.select(
        "session", F.col("seq").cast("long").alias("seq"), "m.role", content_text(F.col("m.content")).alias("content"),
        F.coalesce("m.sender_id", F.lit("")).alias("sender_id"), F.coalesce("m.sender_name", F.lit("")).alias("sender_name"), F.col("m.timestamp").alias("ts"), "m.is_processed",
    )


def native_pair(session: str, question: Column, answer: Column, now: Column) -> Column:
    """A turn given as question and answer, as two records."""
    make = lambda role, text, seq: F.struct(F.lit(session).alias("session"), F.lit(seq).cast("long").alias("seq"), F.lit(role).alias("role"), text.alias("content"), now.alias("ts"))
    return F.filter(F.array(make("user", question, 0), make("assistant", answer, 1)), lambda r: F.trim(F.coalesce(r["content"], F.lit(""))) != "")
