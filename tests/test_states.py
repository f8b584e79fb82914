"""State bytes of every family: fixed vectors, round trips, damage."""

import base64

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sketchspark import codec, states
from sketchspark.errors import DeserializationError, InvalidOption
from sketchspark.functions.hashing import MASK
from sketchspark.operators import cardinality as card
from sketchspark.operators import frequency as freq
from sketchspark.operators import membership as mem
from sketchspark.operators import quantile as quant
from sketchspark.operators import reconcile as rec

# Frames of 16 numbers in a DDSketch (alpha 0.01) and of "hello" in frequent items (k 10).
DDSKETCH = (
    "RVhTSwIFAQAeAAEAAAAAAAAAAAAFAQAAAAC8AAAACAAAAHsUrkfheoQ/RERTMQEAAAB7FK5H4XqEP/1KgVq/UvA/fQWdBQ57lD8BAAAAAAAAABAAAAAAAAAAAAAAAAAAAAAAAAAAAADwPwAAAAAAAGJACwAAAAAAAAAAAAAA"
    "AAAAAAAAAAAEAAAAIgAAAAIAAAA2AAAAAgAAAFAAAAABAAAAZwAAAAEAAACAAAAAAQAAAJgAAAABAAAAsAAAAAEAAADIAAAAAQAAAOAAAAABAAAA+AAAAAEAAACGRtrN"
)
FREQUENT = "RVhTSwIGAQAeAAEAAAAAAAAAAAAGAQAAAABCAAAABQAAAAoAAAAARkkxAAEAAAAKAAAAAQAAAAAAAAABAAAAAAAAAAAAAAAFAAAAaGVsbG8BAAAAAAAAAAAAAAAAAAAAn0mweA=="


def test_vectors(spark):
    values = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 1, 1, 2, 3)], "v double")
    assert bytes(states.to_frames(quant.ddsketch(values, "v"), "ddsketch").first()[0]) == base64.b64decode(DDSKETCH)
    items = spark.createDataFrame([("hello",)], "i string")
    assert bytes(states.to_frames(freq.frequent_items(items, "i"), "frequent_items").first()[0]) == base64.b64decode(FREQUENT)


def _states(df):
    c, g = "item", ["grp"]
    per = lambda f: f(df.where("grp = 'a'")).withColumn("grp", F.lit("a")).unionByName(f(df.where("grp = 'b'")).withColumn("grp", F.lit("b")))
    return {
        "hll": (card.hll(df, c, g, p=6), {"p": 6}),
        "ull": (card.ull(df, c, g, p=6), {"p": 6}),
        "cms": (freq.cms(df, c, g, width=50, depth=3), {"width": 50, "depth": 3}),
        "theta": (card.theta(df, c, g, k=64), {"k": 64}),
        "kll": (quant.compactor(df, "v", g, k=20), {"k": 20}),
        "req": (quant.compactor(df, "v", g, k=12, kind="req_high"), {}),
        "ddsketch": (quant.ddsketch(df, "v", g), {}),
        "frequent_items": (freq.frequent_items(df, c, g, k=7), {"k": 7}),
        "misra_gries": (freq.misra_gries(df, c, g, k=7), {"k": 7, "n": 400}),
        "bloom": (per(lambda d: mem.bloom(d, c, 500)), {"capacity": 500}),
        "quotient": (per(lambda d: mem.quotient(d, c, 9, 8)), {"q": 9, "r": 8}),
        "cqf": (per(lambda d: mem.cqf(d, c, 10, 32)), {"q": 10, "r": 32}),
        "cuckoo": (per(lambda d: mem.cuckoo(d.dropDuplicates([c]), c, 500, 12)), {"capacity": 500, "bits": 12}),
        "xor": (per(lambda d: mem.xor_build(d, c, shards=2)), {}),
        "iblt": (per(lambda d: rec.iblt(d, c, "v", cells=300)), {"cells": 300}),
    }


def test_round_trip_of_every_family(spark):
    df = spark.range(800).selectExpr("if(id % 2 = 0, 'a', 'b') grp", "cast(id % 370 as string) item", "cast(id % 97 as double) v").cache()
    found = _states(df)
    assert set(found) == set(states.LAYOUTS) == set(codec.FAMILIES)
    for family, (rows, options) in found.items():
        by = ["grp", "shard"] if family == "xor" else ["grp"]
        want = rows.drop("low", "high").cache()
        frames = states.to_frames(rows, family, by, **options).cache()
        again = states.from_frames(frames, family, by)
        if family == "theta":  # what lies at or above theta goes
            want = want.where((F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))) < F.col("theta").bitwiseXOR(F.lit(-(1 << 63))))
        got = again.select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), family
        second = states.to_frames(again, family, by, **options)
        if family not in ("misra_gries",):
            assert {bytes(r["frame"]) for r in second.collect()} == {bytes(r["frame"]) for r in frames.collect()}, family
    with pytest.raises(Exception, match="not hll"):
        states.from_frames(frames, "hll", ["grp"]).collect()


@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 3)), max_size=16))
@settings(max_examples=200, deadline=None)
def test_slots(found):
    found = sorted(found)
    body = states.slots(np.array([q for q, _ in found], np.int64), np.array([r for _, r in found], np.int64), 4, 2)
    assert sorted(states.fingerprints(body, 4, 2)) == found
    if found:
        table = [b & 7 for b in body]
        assert {i for i, m in enumerate(table) if m & 1} == {q for q, _ in found}


def test_full_filters_raise():
    many = pd.DataFrame({"q": [0] * 5, "r": range(5)})
    with pytest.raises(InvalidOption):
        states.to_frame("quotient", many, q=2, r=8)
    with pytest.raises(InvalidOption):
        states.to_frame("cuckoo", pd.DataFrame({"pair": [0], "fp": [9], "count": [99]}), capacity=20)


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_damaged_states(data):
    frame = codec.decode(states.to_frame("iblt", pd.DataFrame({"cell": [1], "count": [1], "key_sum": [-5], "value_sum": [0], "check_sum": [7]}), cells=4))
    cut = data.draw(st.integers(0, len(frame.state) - 1))
    with pytest.raises(DeserializationError):
        states.from_frame(codec.encode(codec.Frame("iblt", frame.params, frame.state[:cut])))


def test_options_and_seed_come_back():
    raw = states.to_frame("bloom", pd.DataFrame({"pos": [3, 9]}), "xxh3", 7, capacity=100)
    family, options, rows = states.from_frame(raw)
    assert (family, options["strategy"], options["seed"], rows["pos"].tolist()) == ("bloom", "xxh3", 7, [3, 9])
    raw = states.to_frame("misra_gries", pd.DataFrame({"item": ["é", ""], "count": [2, 1]}), n=50)
    assert states.from_frame(raw)[1]["n"] == 50
    with pytest.raises(InvalidOption):
        states.to_frame("hll", pd.DataFrame({"bucket": [], "value": []}), q=3)


def test_chain_and_compact_theta():
    chain = states.pack_chain([b"one", b""], [b"adjunct"])
    assert states.unpack_chain(chain) == ([b"one", b""], [b"adjunct"])
    with pytest.raises(DeserializationError):
        states.unpack_chain(chain[:-1])
    assert states.seed_hash(9001) == 0x93CC
    for hashes, theta, longs in (([], MASK, 1), ([5], MASK, 1), ([9, 5], MASK, 2), ([9, 5], 1 << 62, 3)):
        raw = states.theta_to_compact(hashes, theta, 64)
        assert raw[0] == longs and len(raw) == 8 * (longs + len(hashes))
        assert states.theta_from_compact(raw) == (64, theta, sorted(hashes))
        with pytest.raises(DeserializationError):
            states.theta_from_compact(raw, seed=1)


def test_compact_theta_of_groups(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'b') grp", "cast(id as string) item")
    state = card.theta(rows, "item", ["grp"], k=64)
    packed = states.theta_to_compacts(state, ["grp"], k=64)
    again = states.theta_from_compacts(packed, ["grp"])
    assert sorted(map(str, again.collect())) == sorted(map(str, state.collect()))
    assert {r["grp"]: states.theta_from_compact(bytes(r["compact"]))[0] for r in packed.collect()} == {"a": 64, "b": 64}


def test_iblt_member_and_chain_count(spark):
    df = spark.range(50).selectExpr("cast(id as string) item")
    table = rec.iblt(df, "item", cells=1000)
    said = rec.iblt_member(table, spark.range(100).selectExpr("cast(id as string) item"), "item", cells=1000).collect()
    assert all(r["member"] for r in said if int(r["item"]) < 50)
    assert sum(r["member"] for r in said) < 60
    chain = mem.FilterChain().add(mem.stage("cqf", df.union(df), "item")).add(mem.stage("quotient", df, "item"))
    assert chain.count() == 150
    adjoined = chain.adjoin(table)
    assert len(adjoined.adjuncts) == 1 and len(adjoined.put(df, "item").adjuncts) == 1


def test_more_fingerprints_than_slots(spark):
    """Filters that one frame can't hold take several, and nothing is lost; smaller groups keep one frame."""
    df = spark.range(3000).selectExpr("if(id < 2900, 'a', null) grp", "cast(id % 1450 as string) item").cache()
    per = lambda f: f(df.where("grp = 'a'")).withColumn("grp", F.lit("a")).unionByName(f(df.where("grp IS NULL")).withColumn("grp", F.lit(None).cast("string")))
    for family, rows, options in (
        ("quotient", per(lambda d: mem.quotient(d, "item", 8, 32)), {"q": 8, "r": 32}),
        ("cqf", per(lambda d: mem.cqf(d, "item", 8, 32)), {"q": 8, "r": 32}),
        ("cuckoo", per(lambda d: mem.cuckoo(d, "item", 300, 16)), {"capacity": 300, "bits": 16}),
        ("cqf", spark.sql("SELECT 'a' AS grp, 1L AS q, 2L AS r, 900L AS count"), {"q": 8, "r": 32}),
    ):
        frames = states.to_frames(rows, family, ["grp"], **options).cache()
        assert frames.where("grp = 'a'").count() > 1 and frames.where("grp IS NULL").count() <= 1
        again = states.from_frames(frames, family, ["grp"]).select(*rows.columns)
        assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect())), family
        one = rows.where("grp = 'a'").drop("grp")
        plain = states.from_frames(states.to_frames(one, family, **options), family).select(*one.columns)
        assert sorted(map(str, plain.collect())) == sorted(map(str, one.collect())), family
