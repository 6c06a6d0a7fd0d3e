import json

import pytest
from pyspark.sql import functions as F

from memlattice.sources import services as S


def test_batches_are_halved_and_checked():
    calls = []

    def call(batch):
        calls.append(len(batch))
        if len(batch) > 3:
            raise S.TooLarge
        return [[float(len(t))] for t in batch]

    texts = ["a" * k for k in range(10)]
    assert S.embed_all(call, texts, 8) == [[float(k)] for k in range(10)] and calls[0] == 8
    assert S.embed_all(lambda b: [[1.0]], ["a", "b"]) == [[1.0], [1.0]]
    with pytest.raises(ValueError):
        S.embed_all(lambda b: [[1.0]] * 2, ["a", "b", "c"])
    with pytest.raises(S.TooLarge):
        S.embed_all(call if False else lambda b: (_ for _ in ()).throw(S.TooLarge()), ["a"])


def test_embedder_and_space(spark):
    df = spark.createDataFrame([("ab", "m1"), (None, "m2")], "t string, model string")
    out = df.withColumn("embedding", S.embedder(lambda: lambda b: [[float(len(t)), 1.0] for t in b])(F.col("t")))
    assert sorted(list(r.embedding) for r in out.collect()) == [[0.0, 1.0], [2.0, 1.0]]
    assert S.in_model_space(out, "m1", 2).count() == 1 and S.in_model_space(out, "m1", 3).count() == 0


def test_host_records(spark):
    messages = [{"role": "user", "content": [{"type": "text", "text": "hi"}], "sender_id": "1", "timestamp": 2.0}, {"role": "assistant", "content": "yo", "is_processed": False}]
    got = S.host_records(spark.createDataFrame([("s", json.dumps(messages)), ("t", "[]"), ("u", None)], "session string, value string")).collect()
    assert [(r.seq, r.content, r.sender_id) for r in got] == [(0, "hi", "1"), (1, "yo", "")]
    pair = spark.range(1).select(S.native_pair("s", F.lit("q"), F.lit(" "), F.lit(1.0)).alias("x")).first().x
    assert [r.role for r in pair] == ["user"]
