"""Merge laws, guarantees and layouts that need no table."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchspark import catalog, codec, compat
from sketchspark.errors import DeserializationError, IncompatibleSketches, InvalidChainComposition, InvalidOption, UnsupportedOperation
from sketchspark.functions.hashing import hash64, murmur3_128
from sketchspark.operators import cardinality as card
from sketchspark.operators import frequency as freq
from sketchspark.operators import membership as mem
from sketchspark.operators import quantile as quant
from sketchspark.operators import reconcile as rec
from sketchspark.operators.frequency import misra_gries_fold, space_saving
from sketchspark.operators.quantile import CompactorSketch


def test_check_vectors():
    assert codec.crc32c(b"123456789") == 0xE3069283
    assert murmur3_128(b"hello")[0] == 0xCBD8A7B341BD9B02


@given(st.lists(st.floats(-1e6, 1e6), max_size=400), st.sampled_from(["kll", "req_high", "req_low"]))
@settings(max_examples=60, deadline=None)
def test_compactor_round_trip_and_counts(values, kind):
    s = CompactorSketch(12, kind)
    s.update(values)
    again = CompactorSketch.from_bytes(s.to_bytes())
    assert again.to_bytes() == s.to_bytes()
    assert again.n == len(values)
    if values:
        assert (again.quantile(0), again.quantile(1)) == (min(values), max(values))
        assert s.merge(again).n == 2 * len(values)


def test_kll_rank_error():
    values = random.Random(1).sample(range(100_000), 50_000)
    s = CompactorSketch(200)
    for i in range(0, len(values), 5000):
        part = CompactorSketch(200)
        part.update(values[i : i + 5000])
        s = s.merge(part)
    exact = sorted(values)
    for q in (0.01, 0.25, 0.5, 0.75, 0.99):
        assert abs(sum(v <= s.quantile(q) for v in exact) / len(exact) - q) < 3 * 1.66 / 200**0.5


def test_incompatible():
    with pytest.raises(IncompatibleSketches):
        CompactorSketch(200).merge(CompactorSketch(100))
    with pytest.raises(InvalidOption):
        CompactorSketch(3)


@given(st.binary(max_size=60), st.binary(max_size=10), st.sampled_from(sorted(codec.FAMILIES)))
@settings(max_examples=50, deadline=None)
def test_frames(state, params, family):
    frame = codec.Frame(family, params, state, "xxh3", 7)
    raw = codec.encode(frame)
    assert codec.decode(raw) == frame
    for i in range(0, 8 * len(raw), 7):
        bad = bytearray(raw)
        bad[i // 8] ^= 1 << i % 8
        with pytest.raises(DeserializationError):
            codec.decode(bytes(bad))


@given(st.lists(st.sampled_from("abcdefgh"), max_size=200), st.integers(1, 6))
@settings(max_examples=50, deadline=None)
def test_heavy_hitters(items, k):
    true = {i: items.count(i) for i in set(items)}
    for item, count, error in space_saving([(i.encode(), n) for i, n in true.items()], k):
        assert count - error <= true[item.decode()] <= count
    held = misra_gries_fold(iter(items), k)
    assert all(0 <= n - held.get(i, 0) <= len(items) / (k + 1) for i, n in true.items())


def test_partition_invariance(spark):
    df = spark.range(5000).selectExpr("cast(id % 1700 as string) item")
    states = [sorted(map(tuple, card.hll(df.repartition(n), "item", p=8).collect())) for n in (1, 4, 16)]
    assert states[0] == states[1] == states[2]
    thetas = [sorted(map(tuple, card.theta(df.repartition(n), "item", k=64).collect())) for n in (1, 7)]
    assert thetas[0] == thetas[1]


def test_empty_and_null(spark):
    empty = spark.createDataFrame([(None,)], "item string")
    assert card.hll(empty, "item").count() == 0
    assert mem.bloom(empty, "item").count() == 0


def test_chain_rules(spark):
    df = spark.range(10).selectExpr("cast(id as string) item")
    chain = mem.FilterChain().add(mem.stage("cuckoo", df, "item")).add(mem.stage("xor", df.limit(5), "item"))
    with pytest.raises(InvalidChainComposition):
        chain.add(mem.stage("bloom", df, "item"))
    with pytest.raises(UnsupportedOperation):
        chain.delete(df, "item")


def test_stream_registers(spark, tmp_path):
    from sketchspark.streaming.windows import windowed_hll, write_state

    rows = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", f"u{i}") for h in range(4) for i in range(30)], "t string, u string").selectExpr("cast(t as timestamp) ts", "u")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = write_state(windowed_hll(stream, "u", "ts", watermark="10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = windowed_hll(rows, "u", "ts")
    closed = got.select("window_start").distinct().count()
    assert closed == 3  # the last window is still open
    assert got.exceptAll(want).count() == 0


def test_states_of_other_parameters_do_not_merge(spark):
    df = spark.range(100).selectExpr("cast(id as string) item", "cast(id as double) v")
    pairs = [
        (card.merge_registers, [card.hll(df, "item", p=10), card.hll(df, "item", p=14)]),
        (card.merge_registers, [card.hll(df, "item"), card.hll(df, "item", strategy="xxhash64")]),
        (card.merge_registers, [card.hll(df, "item"), card.ull(df, "item")]),
        (lambda x: card.theta_merge(x, k=64), [card.theta(df, "item", k=64), card.theta(df, "item", k=128)]),
        (freq.cms_merge, [freq.cms(df, "item", width=10), freq.cms(df, "item", width=20)]),
        (freq.misra_gries_merge, [freq.misra_gries(df, "item"), freq.misra_gries(df, "item", k=3)]),
        (quant.ddsketch_merge, [quant.ddsketch(df, "v"), quant.ddsketch(df, "v", alpha=0.1)]),
        (mem.bloom_merge, [mem.bloom(df, "item"), mem.bloom(df, "item", capacity=5)]),
        (mem.quotient_merge, [mem.quotient(df, "item"), mem.quotient(df, "item", r=9)]),
        (mem.cqf_merge, [mem.cqf(df, "item"), mem.cqf(df, "item", q=9)]),
        (rec.iblt_merge, [rec.iblt(df, "item"), rec.iblt(df, "item", seed=1)]),
    ]
    for merge, states in pairs:
        with pytest.raises(IncompatibleSketches):
            merge(states)
        merge(states[:1] * 2)
        assert not compat.compatible(*states)
    with pytest.raises(IncompatibleSketches):
        card.hll_estimate(card.hll(df, "item", p=10))
    with pytest.raises(IncompatibleSketches):
        mem.bloom_member(mem.bloom(df, "item"), df, "item", capacity=5)
    with pytest.raises(UnsupportedOperation):
        quant.cdf(quant.sketch(df, "v", kind="ddsketch"), [1.0], kind="ddsketch")


def test_parameters_survive_parquet(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id as string) item")
    card.hll(df, "item", p=10).write.parquet(str(tmp_path / "s"))
    assert compat.built_with(spark.read.parquet(str(tmp_path / "s")))["p"] == 10


def test_theta_folds_before_the_exchange(spark):
    """Far more distinct hashes than entries, in groups and alone: the same entries as by a plain sort."""
    df = spark.range(0, 60_000, 1, 7).selectExpr("cast(id as string) item", "if(id % 5 = 0, null, id % 3) g")
    for by in ([], ["g"]):
        got = card.theta(df, "item", by, k=64).toPandas()
        every = df.select(*by, card.hash64("item").alias("h")).toPandas()
        every["u"] = every.h.to_numpy().astype("int64").view("uint64")
        for name, part in every.groupby(by, dropna=False) if by else [(None, every)]:
            mine = got if not by else got[got.g.isna()] if name[0] != name[0] else got[got.g == name[0]]
            assert sorted(mine.hash.to_numpy().astype("int64").view("uint64")) == sorted(part.u)[:64]
            assert set(mine.theta.to_numpy().astype("int64").view("uint64")) == {sorted(part.u)[64]}


def test_ull_estimate_of_many():
    """Far beyond the registers: values stand for ranks, so the estimate stays within five standard errors."""
    m, rng = 1 << 12, np.random.default_rng(5)
    for n in (10_000, 100_000, 1_000_000, 10_000_000):
        h = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        rank = 52 - np.floor(np.log2(np.maximum(h & np.uint64((1 << 52) - 1), np.uint64(1)).astype(float))).astype(int)
        top = np.zeros(m, int)
        np.maximum.at(top, (h >> np.uint64(52)).astype(int), rank)
        values, counts = np.unique(2 * top[top > 0] - 1, return_counts=True)
        assert card.ull_from_histogram(dict(zip(values.tolist(), counts.tolist(), strict=True)), 12) == pytest.approx(n, rel=5 * 1.04 / 64)


@pytest.mark.parametrize(("kind", "k", "most"), [("kll", 200, 0.02), ("req_high", 32, 0.03)])
def test_compactors_keep_weights_and_ranks(kind, k, most):
    """Weights add up to n and ranks stay close, in one sketch and in many merged ones, whatever the order."""
    values = np.random.default_rng(3).permutation(120_000).astype(float)
    for order in (values, np.sort(values), np.repeat(values[::20], 20)):
        one, parts = CompactorSketch(k, kind), [CompactorSketch(k, kind) for _ in range(24)]
        one.update(order)
        for i, part in enumerate(parts):
            part.update(order[i::24])
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.merge(part)
        for s in (one, whole):
            assert s.view()[1][-1] == s.n == len(order)
            for q in (0.1, 0.5, 0.9, 0.99):
                assert (np.asarray(order) <= s.quantile(q)).mean() == pytest.approx(q, abs=most)


@pytest.mark.parametrize("name", ["kll_rank_error", "req_rank_error"])
def test_rank_errors_broadcast_the_answers(name, spark, sf):
    """The side that is sent through the driver is named, not left to estimates of sizes."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight, Inner" in plan and "LeftOuter" not in plan


def test_filter_chain_broadcasts_no_state(spark, sf):
    """Bits and fingerprints of all items must not be sent through the driver, however small Spark takes them for."""
    plan = catalog.QUERIES["filter_chain"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_iblt_lists_more_keys_than_cells(spark):
    """A difference that one table can't hold is told whole; repeated keys, which no table tells, end with side 0."""
    a, b = spark.range(0, 900).toDF("k"), spark.range(300, 1000).toDF("k")
    told = sorted(tuple(r) for r in rec.iblt_difference(a, b, "k", cells=50).select("side", "key_hash").collect())
    hashed = lambda df: [r[0] for r in df.select(hash64("k")).collect()]
    assert told == sorted([(1, h) for h in hashed(spark.range(300).toDF("k"))] + [(-1, h) for h in hashed(spark.range(900, 1000).toDF("k"))])
    assert [r.side for r in rec.iblt_difference(a.unionAll(a.where("k = 5")), a, "k", cells=50).collect()] == [1]
    assert {r.side for r in rec.iblt_difference(a.unionAll(a.where("k = 5")), b.where("k <> 5"), "k", cells=50).collect()} >= {0, 1, -1}
    assert rec.iblt_difference(a, a, "k", cells=50).isEmpty()
