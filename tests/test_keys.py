"""Message keys against the JSON library, and the smallest rows by key against a sort."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from suiteforge.functions import hashing as h
from suiteforge.operators import sampling


def test_messages_json_is_that_of_the_library(spark):
    draw = random.Random(1)
    alphabet = ["a", "Z", " ", '"', "\\", "/", "\n", "\r", "\t", "\b", "\f", "\x00", "\x1f", "\x7f", "é", "ß", "日", " ", "￿", "\U0001f600", "\U0010ffff", "<", "{"]
    lists = [[{"role": draw.choice(["user", "ü"]), "content": None if draw.random() < 0.1 else "".join(draw.choice(alphabet) for _ in range(draw.randrange(9)))} for _ in range(draw.randrange(4))] for _ in range(200)]
    rows = [(i, m) for i, m in enumerate(lists)] + [(1000, None)]
    df = spark.createDataFrame(rows, "i long, m array<struct<role:string,content:string>>")
    for r in df.select("i", h.messages_json("m").alias("j"), h.messages_key("m").alias("k"), h.messages_key_compat("m").alias("c")).collect():
        if r.i == 1000:
            assert (r.j, r.k) == (None, None)
        else:
            assert r.j == json.dumps(lists[r.i], sort_keys=True, separators=(",", ":"))
            assert r.k == r.c == hashlib.sha256(r.j.encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 7, 400, 999, 1000, 5000])
def test_smallest_is_the_head_of_a_sort(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "CUT_ROWS", 3)
    df = spark.range(1000).select((F.col("id") % 970).alias("k")).repartition(5)
    key = F.md5(F.col("k").cast("string"))
    want = sorted(r.x for r in df.orderBy(key).limit(n).select(key.alias("x")).collect())
    for digits in (1, 3):
        assert sorted(r.x for r in sampling.smallest(df, key, n, digits).select(key.alias("x")).collect()) == want


def test_a_sample_of_a_third_needs_no_global_sort(spark):
    plan = sampling.seeded_sample(spark.range(3000).withColumnRenamed("id", "k"), "k", 1000)
    assert plan.count() == 1000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "limit=1000" not in text and "Limit 1000" not in text
