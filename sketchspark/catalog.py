"""Registered queries and their DuckDB oracles.

Most oracles run the same algorithm in SQL; those of randomised or order-dependent sketches
state what must hold (no false negatives, errors within bounds) over exact answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec, states
from .functions.hashing import hash64
from .operators import cardinality as card
from .operators import frequency as freq
from .operators import membership as mem
from .operators import quantile as quant
from .operators import reconcile as rec
from .plans import reports
from .sources.tables import read
from .streaming import windows as win

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.users_and_values(read(spark, sf_dir, "events", "event_type", "user_id", "value"))


# --- SQL of the hash and of HLL registers ------------------------------------------------------


def _h(col: str) -> str:
    return f"('0x' || substr(md5(CAST({col} AS VARCHAR)), 1, 16))::UBIGINT"


def _registers(table: str, col: str, by: str, p: int, where: str = "true") -> str:
    rest = f"(h & {(1 << (64 - p)) - 1}::UBIGINT)"
    rank = f"CASE WHEN {rest} = 0 THEN {65 - p} ELSE {64 - p} - length(bin({rest})) + 1 END"
    lead = f"{by}, " if by else ""
    return f"SELECT {lead}CAST(h >> {64 - p} AS INTEGER) AS bucket, CAST(max({rank}) AS INTEGER) AS value FROM (SELECT {lead}{_h(col)} AS h FROM {table} WHERE {col} IS NOT NULL AND {where}) GROUP BY ALL"


def _hll(registers: str, by: str, p: int) -> str:
    m = 1 << p
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}round(CASE WHEN raw <= {2.5 * m} AND n < {m} THEN {float(m)} * ln({float(m)} / ({m} - n)) ELSE raw END, 6) AS estimate, n AS n_registers
FROM (SELECT {lead}{card.hll_alpha(m) * m * m!r} / (sum(pow(2.0, -value)) + {m} - count(*)) AS raw, count(*) AS n FROM ({registers}) {f'GROUP BY {by}' if by else ''})"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- HLL ---------------------------------------------------------------------------------------


@query(_hll(_registers("events", "user_id", "", 14), "", 14))
def hll_distinct_users(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(card.hll_estimate(card.hll(read(spark, sf, "events", "user_id"), "user_id")), "estimate")


@query(_hll(_registers("events", "user_id", "event_type", 14), "event_type", 14))
def hll_by_event_type(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(card.hll_estimate(card.hll(read(spark, sf, "events", "user_id", "event_type"), "user_id", ["event_type"]), ["event_type"]), "estimate")


@query(_hll(_registers("events", "user_id", "", 14), "", 14))
def hll_merge_two_halves(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events", "event_id", "user_id")
    halves = [card.hll(events.where(F.col("event_id") % 2 == i), "user_id") for i in (0, 1)]
    return _rounded(card.hll_estimate(card.merge_registers(halves)), "estimate")


@query(_registers("lineitem", "l_partkey", "", 10))
def hll_registers(spark: SparkSession, sf: str) -> DataFrame:
    return card.hll(read(spark, sf, "lineitem", "l_partkey"), "l_partkey", p=10)


@query(_hll(f"SELECT r_name, bucket, max(value) AS value FROM ({_registers('customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey', 'c_custkey', 'r_name', 12)}) GROUP BY ALL", "r_name", 12))
def rollup_hll(spark: SparkSession, sf: str) -> DataFrame:
    """Customers per region, from the registers of nations."""
    nations = card.hll(read(spark, sf, "customer", "c_custkey", "c_nationkey"), "c_custkey", ["c_nationkey"], p=12)
    named = nations.join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _rounded(card.hll_estimate(card.merge_registers([named.select("r_name", "bucket", "value")], ["r_name"]), ["r_name"], p=12), "estimate")


_HOURS = "(SELECT *, date_trunc('hour', ts) AS window_start FROM events)"


@query(f"SELECT epoch(window_start)::BIGINT AS window_start, estimate, n_registers FROM ({_hll(_registers(_HOURS, 'user_id', 'window_start', 12), 'window_start', 12)})")
def windowed_hll(spark: SparkSession, sf: str) -> DataFrame:
    state = win.windowed_hll(read(spark, sf, "events", "ts", "user_id"), "user_id", "ts")
    return _rounded(card.hll_estimate(state, ["window_start"], p=12), "estimate").withColumn("window_start", F.col("window_start").cast("timestamp").cast("long"))


@query(_hll(_registers("documents", "text", "", 14), "", 14))
def doc_dedup_hll(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(card.hll_estimate(card.hll(read(spark, sf, "documents", "text"), "text")), "estimate")


# --- ULL ---------------------------------------------------------------------------------------

_ULL = f"SELECT bucket, CAST(CASE WHEN value = 55 THEN 110 ELSE 2 * value - 1 END AS INTEGER) AS value FROM ({_registers('lineitem', 'l_partkey', '', 10)})"


@query(_ULL)
def ull_registers(spark: SparkSession, sf: str) -> DataFrame:
    return card.ull(read(spark, sf, "lineitem", "l_partkey"), "l_partkey", p=10)


@query("SELECT event_type, true AS within FROM events GROUP BY event_type")
def ull_estimate(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events", "event_type", "user_id")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    return card.ull_estimate(card.ull(events, "user_id", ["event_type"]), ["event_type"]).join(exact, "event_type").select("event_type", (F.abs(F.col("estimate") / F.col("n") - 1) < 0.05).alias("within"))


# --- Theta -------------------------------------------------------------------------------------


def _theta(table: str, col: str, by: str, k: int) -> str:
    lead, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"SELECT {lead}h, n, c FROM (SELECT *, row_number() OVER ({part}ORDER BY h) AS n, count(*) OVER ({part.strip()}) AS c FROM (SELECT DISTINCT {lead}{_h(col)} AS h FROM {table})) WHERE n <= {k + 1}"


def _theta_estimate(table: str, col: str, by: str, k: int) -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"SELECT {lead}round(CASE WHEN max(c) <= {k} THEN max(c) ELSE {k} * 18446744073709551616.0 / CAST(max(CASE WHEN n = {k + 1} THEN h END) AS DOUBLE) END, 6) AS estimate, CAST(least(max(c), {k}) AS BIGINT) AS n_entries FROM ({_theta(table, col, by, k)}) {group}"


@query(_theta_estimate("orders", "o_custkey", "", 64))
def theta_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(card.theta_estimate(card.theta(read(spark, sf, "orders", "o_custkey"), "o_custkey", k=64)), "estimate")


@query(_theta_estimate("orders", "o_custkey", "", 64))
def theta_union(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders", "o_custkey", "o_orderpriority")
    by = card.theta(orders, "o_custkey", ["o_orderpriority"], k=64).drop("o_orderpriority")
    return _rounded(card.theta_estimate(card.theta_merge([by], k=64)), "estimate")


@query(_theta_estimate("orders", "o_custkey", "o_orderpriority", 64))
def theta_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    state = card.theta(read(spark, sf, "orders", "o_custkey", "o_orderpriority"), "o_custkey", ["o_orderpriority"], k=64)
    return _rounded(card.theta_estimate(state, ["o_orderpriority"]), "estimate")


@query("""WITH c AS (SELECT DISTINCT o_orderpriority AS g, o_custkey AS k FROM orders), n AS (SELECT g, count(*) AS n FROM c GROUP BY ALL),
i AS (SELECT x.g AS a, y.g AS b, count(*) AS i FROM c x JOIN c y ON x.k = y.k AND x.g < y.g GROUP BY ALL)
SELECT a, b, round(i / CAST(p.n + q.n - i AS DOUBLE), 6) AS jaccard FROM i JOIN n p ON p.g = a JOIN n q ON q.g = b""")
def theta_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Exact while every cohort has fewer than k customers."""
    k = 1 << 20
    state = card.theta(read(spark, sf, "orders", "o_custkey", "o_orderpriority"), "o_custkey", ["o_orderpriority"], k=k)
    return _rounded(card.theta_overlap(state, "o_orderpriority", k).select("a", "b", "jaccard"), "jaccard")


_DIFFERENCE = """WITH e AS (SELECT DISTINCT {0} AS h, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O')),
k AS (SELECT s, h, row_number() OVER (PARTITION BY s ORDER BY h) AS n FROM e),
t AS (SELECT min(h) AS theta FROM k WHERE n = 65),
a AS (SELECT h FROM k WHERE s = 'F' AND n <= 64 AND h < (SELECT theta FROM t)), b AS (SELECT h FROM k WHERE s = 'O' AND n <= 64)
SELECT count(*) AS entries, CAST(bit_xor(h) AS VARCHAR) AS hashes FROM a WHERE h NOT IN (SELECT h FROM b)"""


@query(_DIFFERENCE.format(_h("o_custkey")))
def theta_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of finished orders but no open ones, from states of 64 entries, which are trimmed."""
    from .functions.hashing import unsigned

    orders = read(spark, sf, "orders", "o_orderstatus", "o_custkey")
    a, b = (card.theta(orders.where(F.col("o_orderstatus") == x), "o_custkey", k=64) for x in "FO")
    return card.theta_difference(a, b).agg(F.count("*").alias("entries"), unsigned(F.bit_xor("hash")).cast("string").alias("hashes"))


@query(f"SELECT CAST(h AS VARCHAR) AS hash FROM ({_theta('orders', 'o_custkey', '', 64)}) WHERE n <= 64")
def theta_compact_entries(spark: SparkSession, sf: str) -> DataFrame:
    from .functions.hashing import unsigned

    state = card.theta_compact(card.theta(read(spark, sf, "orders", "o_custkey"), "o_custkey", k=64))
    return state.select(F.explode("hashes").alias("h")).select(unsigned(F.col("h")).cast("string").alias("hash"))


# --- Count-Min ---------------------------------------------------------------------------------


def _cms(width: int, depth: int, items: str) -> str:
    return f"""SELECT item, CAST(r AS INTEGER) AS r, CAST((h::HUGEINT + (r * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT % {width} AS INTEGER) AS slot, w
FROM (SELECT item, {_h('item')} AS h, w FROM ({items})) CROSS JOIN range({depth}) t(r)"""


_PARTS = "SELECT l_partkey AS item, count(*) AS w FROM lineitem GROUP BY ALL"
_QUANTITY = "SELECT l_partkey AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY ALL"


@query(f"WITH c AS ({_cms(2039, 5, _PARTS)}), s AS (SELECT r, slot, sum(w) AS n FROM c GROUP BY ALL) SELECT item AS l_partkey, CAST(min(n) AS BIGINT) AS estimate FROM c JOIN s USING (r, slot) GROUP BY ALL")
def cms_point_estimates(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem", "l_partkey")
    return freq.cms_estimate(freq.cms(items, "l_partkey", width=2039), items, "l_partkey", width=2039)


@query("SELECT count(DISTINCT l_partkey) AS items, CAST(0 AS BIGINT) AS under FROM lineitem")
def cms_never_undercounts(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem", "l_partkey")
    asked = freq.cms_estimate(freq.cms(items, "l_partkey", independent=True), items, "l_partkey", independent=True)
    return asked.join(items.groupBy("l_partkey").count(), "l_partkey").agg(F.count("*").alias("items"), F.count(F.when(F.col("estimate") < F.col("count"), 1)).alias("under"))


@query(f'SELECT r AS "row", slot, CAST(sum(w) AS BIGINT) AS "count" FROM ({_cms(509, 4, _PARTS)}) GROUP BY ALL')
def cms_merge(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem", "l_partkey", "l_orderkey")
    return freq.cms_merge([freq.cms(items.where(F.col("l_orderkey") % 2 == i), "l_partkey", width=509, depth=4) for i in (0, 1)])


@query(f'SELECT r AS "row", slot, CAST(least(sum(w), 4294967295) AS BIGINT) AS "count" FROM ({_cms(509, 4, _QUANTITY)}) GROUP BY ALL')
def cms_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return freq.cms(read(spark, sf, "lineitem", "l_partkey", "l_quantity"), "l_partkey", width=509, depth=4, weight="l_quantity")


# --- DDSketch ----------------------------------------------------------------------------------

_LN = "ln(1.01e0 / 0.99e0)"


@query(f'SELECT CAST(floor(ln(value) / {_LN}) AS INTEGER) AS bin, count(*) AS "count" FROM events GROUP BY ALL')
def ddsketch_bins(spark: SparkSession, sf: str) -> DataFrame:
    return quant.ddsketch(read(spark, sf, "events", "value"), "value").select("bin", "count")


_DDQ = """WITH b AS (SELECT {by} CAST(floor(ln({v}) / {ln}) AS INTEGER) AS bin, count(*) AS c FROM {t} GROUP BY ALL),
w AS (SELECT *, sum(c) OVER ({p} ORDER BY bin) AS cum, sum(c) OVER ({p}) AS n FROM b)
SELECT {by} rank, round(2 * pow(1.01e0 / 0.99e0, min(bin) + 1) / (1.01e0 / 0.99e0 + 1), 6) AS value FROM w, (VALUES (0.5e0), (0.95e0), (0.99e0)) r(rank) WHERE cum >= rank * n GROUP BY ALL"""


@query(_DDQ.format(by="l_returnflag,", v="l_extendedprice", t="lineitem", p="PARTITION BY l_returnflag", ln=_LN))
def ddsketch_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    state = quant.ddsketch(read(spark, sf, "lineitem", "l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"])
    return _rounded(quant.ddsketch_quantiles(state, [0.5, 0.95, 0.99], ["l_returnflag"]), "value")


@query(_DDQ.format(by="", v="value", t="events", p="", ln=_LN))
def ddsketch_merge(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events", "event_id", "value")
    parts = [quant.ddsketch(events.where(F.col("event_id") % 3 == i), "value") for i in range(3)]
    return _rounded(quant.ddsketch_quantiles(quant.ddsketch_merge(parts), [0.5, 0.95, 0.99]), "value")


@query(f"SELECT event_type, round(count(*) FILTER (WHERE floor(ln(value) / {_LN}) <= floor(ln(100e0) / {_LN})) / CAST(count(*) AS DOUBLE), 6) AS rank FROM events GROUP BY ALL")
def ddsketch_rank(spark: SparkSession, sf: str) -> DataFrame:
    state = quant.ddsketch(read(spark, sf, "events", "event_type", "value"), "value", ["event_type"])
    return _rounded(quant.ddsketch_rank(state, 100.0, ["event_type"]), "rank")


# --- KLL, REQ, facade --------------------------------------------------------------------------

_FEW = {"kll": "n_nationkey", "req": "r_regionkey"}


@query("""WITH v AS (SELECT CAST(n_nationkey AS DOUBLE) AS x, row_number() OVER (ORDER BY n_nationkey) AS i, count(*) OVER () AS n FROM nation)
SELECT rank, (SELECT min(x) FROM v WHERE i > rank * n) AS value, (SELECT count(*) FROM v WHERE x <= 10) / CAST((SELECT count(*) FROM v) AS DOUBLE) AS rank_of_10 FROM (VALUES (0.25e0), (0.5e0), (0.75e0)) r(rank)""")
def kll_small_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Below the first level's capacity nothing is compacted, so answers are exact."""
    state = quant.compactor(read(spark, sf, "nation", "n_nationkey"), "n_nationkey")
    asked = quant.compactor_query(state, quantiles=[0.25, 0.5, 0.75], ranks=[10.0])
    return asked.select(F.explode(F.arrays_zip(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)).alias("rank"), F.col("quantiles").alias("value"))).alias("r"), F.col("ranks")[0].alias("rank_of_10")).select("r.rank", "r.value", "rank_of_10")


@query("""WITH v AS (SELECT CAST(r_regionkey AS DOUBLE) AS x, row_number() OVER (ORDER BY r_regionkey) AS i, count(*) OVER () AS n FROM region)
SELECT rank, (SELECT min(x) FROM v WHERE i > rank * n) AS value FROM (VALUES (0.25e0), (0.5e0), (0.75e0)) r(rank)""")
def req_small_exact(spark: SparkSession, sf: str) -> DataFrame:
    return quant.quantiles(read(spark, sf, "region", "r_regionkey"), "r_regionkey", [0.25, 0.5, 0.75], kind="req")


def _rank_errors(spark: SparkSession, sf: str, kind: str, most: float, **options) -> DataFrame:
    """Whether the share of exact values up to each answer is within the promise."""
    items = read(spark, sf, "lineitem", "l_extendedprice")
    asked = quant.quantiles(items, "l_extendedprice", [0.1, 0.5, 0.9, 0.99], kind=kind, **options)
    # the few answers are sent, whatever Spark estimates: all items must not pass through the driver
    both = items.join(F.broadcast(asked), F.lit(True))
    return both.groupBy("rank").agg((F.abs(F.count(F.when(F.col("l_extendedprice") <= F.col("value"), 1)) / F.count("*") - F.col("rank")) <= most).alias("within"))


_WITHIN = "SELECT rank, true AS within FROM (VALUES (0.1e0), (0.5e0), (0.9e0), (0.99e0)) r(rank)"


@query(_WITHIN)
def kll_rank_error(spark: SparkSession, sf: str) -> DataFrame:
    return _rank_errors(spark, sf, "kll", 0.03, k=200)


@query(_WITHIN)
def req_rank_error(spark: SparkSession, sf: str) -> DataFrame:
    return _rank_errors(spark, sf, "req", 0.05, k=32)


@query("SELECT event_type, true AS within FROM events GROUP BY event_type")
def kll_cdf_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of each event type's values up to 50, 150 and 300, within 0.03 of the exact ones."""
    events, splits = read(spark, sf, "events", "event_type", "value"), [50.0, 150.0, 300.0]
    told = quant.cdf(quant.sketch(events, "value", ["event_type"]), splits, ["event_type"])
    exact = events.groupBy("event_type").agg(*(F.avg((F.col("value") <= x).cast("double")).alias(f"s{i}") for i, x in enumerate(splits)))
    worst = F.greatest(*(F.abs(F.col("cdf")[i] - F.col(f"s{i}")) for i in range(3)))
    return told.join(exact, "event_type").select("event_type", (worst <= 0.03).alias("within"))


@query("SELECT family, true AS within FROM (VALUES ('kll'), ('req'), ('ddsketch')) f(family)")
def quantiles_facade(spark: SparkSession, sf: str) -> DataFrame:
    """Rank errors where each family is meant to be accurate: 0.03 at the median, for REQ 0.01 at its high end, at k = 200; DDSketch by value, 3 %."""
    events, out = read(spark, sf, "events", "value"), None
    for kind, at, most in (("kll", 0.5, 0.03), ("req", 0.99, 0.01), ("ddsketch", 0.5, 0.03)):
        told = quant.quantiles(events, "value", [at], kind=kind, **({"k": 200} if kind != "ddsketch" else {}))
        both = told.select(F.col("value").alias("told")).join(events, F.lit(True))
        if kind == "ddsketch":
            good = F.abs(F.first("told") / F.percentile("value", at) - 1) <= most
        else:
            good = F.abs(F.avg((F.col("value") <= F.col("told")).cast("double")) - at) <= most
        one = both.agg(good.alias("within")).select(F.lit(kind).alias("family"), "within")
        out = one if out is None else out.unionAll(one)
    return out


# --- heavy hitters -----------------------------------------------------------------------------


@query("SELECT l_returnflag || l_linestatus AS item, count(*) AS \"count\", CAST(0 AS BIGINT) AS error FROM lineitem GROUP BY ALL")
def fi_top_k_exact(spark: SparkSession, sf: str) -> DataFrame:
    pairs = read(spark, sf, "lineitem", "l_returnflag", "l_linestatus").select(F.concat("l_returnflag", "l_linestatus").alias("pair"))
    return freq.frequent_items(pairs, "pair", k=16)


@query("""WITH y AS (SELECT year(l_shipdate) AS y, CAST(l_suppkey AS VARCHAR) AS item, count(*) AS c FROM lineitem GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY c DESC, item) AS n FROM y),
s AS (SELECT item, CAST(sum(c) AS BIGINT) AS c FROM t WHERE n <= 1000000 GROUP BY ALL)
SELECT item, c AS "count" FROM s ORDER BY c DESC, item LIMIT 20""")
def fi_merge_top_k(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem", "l_suppkey", "l_shipdate").withColumn("y", F.year("l_shipdate"))
    years = freq.frequent_items(items, "l_suppkey", ["y"], k=1_000_000).drop("y")
    return freq.top_k(freq.frequent_merge([years], k=1_000_000), [], 20).select("item", "count")


@query("SELECT CAST(least(20, count(DISTINCT l_suppkey)) AS BIGINT) AS entries, CAST(0 AS BIGINT) AS wrong FROM lineitem")
def fi_bounds(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem", "l_suppkey")
    exact = items.groupBy(F.col("l_suppkey").cast("string").alias("item")).agg(F.count("*").alias("n"))
    state = freq.frequent_bounds(freq.frequent_items(items, "l_suppkey", k=20))
    return state.join(exact, "item").agg(F.count("*").alias("entries"), F.count(F.when((F.col("lower") > F.col("n")) | (F.col("upper") < F.col("n")), 1)).alias("wrong"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, true AS tracked, count(*) AS estimate, CAST(0 AS BIGINT) AS error FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1 UNION ALL SELECT 'nobody', false, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT)")
def fi_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Look-ups in a state that holds every item, and of one that it never saw (null there, -1 here)."""
    items = read(spark, sf, "lineitem", "l_suppkey")
    asked = items.where("l_suppkey % 3 = 0").select(F.col("l_suppkey").cast("string").alias("l_suppkey")).unionAll(spark.sql("SELECT 'nobody'"))
    return freq.frequent_estimate(freq.frequent_items(items, "l_suppkey", k=100_000), asked, "l_suppkey").select("l_suppkey", "tracked", F.coalesce("estimate", F.lit(-1)).cast("long").alias("estimate"), F.coalesce("error", F.lit(-1)).cast("long").alias("error"))


@query("SELECT CAST(30 AS BIGINT) AS entries, CAST(0 AS BIGINT) AS wrong, true AS evicted")
def fi_evicts(spark: SparkSession, sf: str) -> DataFrame:
    """More parts than counters: 30 counters stay, bounds hold for all of them, and errors show that items were replaced."""
    items = read(spark, sf, "lineitem", "l_partkey")
    exact = items.groupBy(F.col("l_partkey").cast("string").alias("item")).agg(F.count("*").alias("n"))
    state = freq.frequent_bounds(freq.frequent_items(items, "l_partkey", k=30))
    return state.join(exact, "item").agg(F.count("*").alias("entries"), F.count(F.when((F.col("lower") > F.col("n")) | (F.col("upper") < F.col("n")), 1)).alias("wrong"), (F.max("error") > 0).alias("evicted"))


_MG = """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS item, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, item) AS i FROM c),
m AS (SELECT item, n - coalesce((SELECT n FROM o WHERE i = 21), 0) AS c FROM o WHERE i <= 20)"""


@query(f"{_MG} SELECT c.item AS user_id, CAST(greatest(coalesce(m.c, 0), 0) AS BIGINT) AS estimate FROM c LEFT JOIN m USING (item)")
def mg_estimate(spark: SparkSession, sf: str) -> DataFrame:
    users = read(spark, sf, "events", "user_id")
    return freq.misra_gries_estimate(freq.misra_gries(users, "user_id", k=20), users, "user_id")


@query(f'{_MG} SELECT item, CAST(c AS BIGINT) AS "count" FROM m WHERE c >= 3')
def mg_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return freq.misra_gries_frequent(freq.misra_gries(read(spark, sf, "events", "user_id"), "user_id", k=20), 3)


@query("""WITH c AS (SELECT event_type AS item, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, item) AS i FROM c)
SELECT item, n - coalesce((SELECT n FROM o WHERE i = 4), 0) AS "count" FROM o WHERE i <= 4 AND n > coalesce((SELECT n FROM o WHERE i = 4), 0)""")
def mg_merge(spark: SparkSession, sf: str) -> DataFrame:
    return freq.misra_gries(read(spark, sf, "events", "event_type"), "event_type", k=3)


@query("SELECT CAST(0 AS BIGINT) AS wrong")
def mg_guarantee(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem", "l_suppkey")
    state = freq.misra_gries(items, "l_suppkey", k=10)
    exact = items.groupBy(F.col("l_suppkey").cast("string").alias("item")).agg(F.count("*").alias("n"))
    bound = items.agg((F.count("*") / 11).alias("bound"))
    both = exact.join(state, "item", "left").join(bound, F.lit(True))
    return both.agg(F.count(F.when((F.coalesce("count", F.lit(0)) > F.col("n")) | (F.col("n") - F.coalesce("count", F.lit(0)) > F.col("bound")), 1)).alias("wrong"))


# --- membership --------------------------------------------------------------------------------

_BITS, _K = mem.bloom_size()
_POS = f"SELECT DISTINCT ((h >> 32) + i * (h & 4294967295::UBIGINT)) % {_BITS} AS pos FROM (SELECT {_h('c_custkey')} AS h FROM customer) CROSS JOIN range({_K}) t(i)"


@query(f"SELECT CAST(pos AS BIGINT) AS pos FROM ({_POS})")
def bloom_bits(spark: SparkSession, sf: str) -> DataFrame:
    return mem.bloom(read(spark, sf, "customer", "c_custkey"), "c_custkey")


@query(f"SELECT CAST(pos AS BIGINT) AS pos FROM ({_POS})")
def bloom_merge(spark: SparkSession, sf: str) -> DataFrame:
    keys = read(spark, sf, "customer", "c_custkey")
    return mem.bloom_merge([mem.bloom(keys.where(F.col("c_custkey") % 2 == i), "c_custkey") for i in (0, 1)])


@query("SELECT count(DISTINCT c_custkey) AS asked, count(DISTINCT c_custkey) AS members FROM customer")
def bloom_no_false_negatives(spark: SparkSession, sf: str) -> DataFrame:
    keys = read(spark, sf, "customer", "c_custkey")
    return mem.bloom_member(mem.bloom(keys, "c_custkey", capacity=1 << 20), keys, "c_custkey", capacity=1 << 20).agg(F.count("*").alias("asked"), F.count(F.when(F.col("member"), 1)).alias("members"))


@query("SELECT true AS within")
def bloom_fpr(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.range(1, 10_001).toDF("k")
    return mem.bloom_member(mem.bloom(keys, "k"), spark.range(10_001, 60_001).toDF("k"), "k").agg((F.avg(F.col("member").cast("double")) < 0.02).alias("within"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def bloom_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    few = read(spark, sf, "customer", "c_custkey", "c_nationkey").where("c_nationkey < 5")
    return reports.bloom_semijoin(read(spark, sf, "orders", "o_orderkey", "o_custkey"), "o_custkey", few, "c_custkey", 50_000)


def _qr(table: str, col: str, where: str = "true") -> str:
    return f"SELECT CAST(h >> 48 AS BIGINT) AS q, CAST((h >> 40) & 255 AS BIGINT) AS r FROM (SELECT {_h(col)} AS h FROM {table} WHERE {where})"


@query(f"SELECT DISTINCT q, r FROM ({_qr('supplier', 's_suppkey')})")
def quotient_set(spark: SparkSession, sf: str) -> DataFrame:
    return mem.quotient(read(spark, sf, "supplier", "s_suppkey"), "s_suppkey")


@query(f"SELECT DISTINCT q, r FROM ({_qr('part', 'p_partkey')}) EXCEPT SELECT q, r FROM ({_qr('part', 'p_partkey', 'p_partkey % 3 = 0')})")
def quotient_delete(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "part", "p_partkey")
    return mem.quotient_delete(mem.quotient(parts, "p_partkey"), parts.where("p_partkey % 3 = 0"), "p_partkey")


@query(f"SELECT q, r FROM ({_qr('part', 'p_partkey')}) UNION SELECT q, r FROM ({_qr('supplier', 's_suppkey')})")
def quotient_merge(spark: SparkSession, sf: str) -> DataFrame:
    return mem.quotient_merge([mem.quotient(read(spark, sf, "part", "p_partkey"), "p_partkey"), mem.quotient(read(spark, sf, "supplier", "s_suppkey"), "s_suppkey")])


@query("SELECT count(*) AS asked, count(*) AS members FROM part")
def quotient_member(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "part", "p_partkey")
    return mem.quotient_member(mem.quotient(parts, "p_partkey"), parts, "p_partkey").agg(F.count("*").alias("asked"), F.count(F.when(F.col("member"), 1)).alias("members"))


@query(f'SELECT q, r, count(*) AS "count" FROM ({_qr("lineitem", "l_suppkey")}) GROUP BY ALL')
def cqf_counts(spark: SparkSession, sf: str) -> DataFrame:
    return mem.cqf(read(spark, sf, "lineitem", "l_suppkey"), "l_suppkey")


@query(f'WITH a AS (SELECT q, r, count(*) AS n FROM ({_qr("lineitem", "l_suppkey")}) GROUP BY ALL), b AS (SELECT q, r, count(*) AS m FROM ({_qr("lineitem", "l_suppkey", "l_linenumber = 1")}) GROUP BY ALL) SELECT q, r, n - coalesce(m, 0) AS "count" FROM a LEFT JOIN b USING (q, r) WHERE n > coalesce(m, 0)')
def cqf_delete(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem", "l_suppkey", "l_linenumber")
    return mem.cqf_delete(mem.cqf(items, "l_suppkey"), items.where("l_linenumber = 1"), "l_suppkey")


@query(f'SELECT q, r, count(*) AS "count" FROM ({_qr("lineitem", "l_suppkey")}) GROUP BY ALL')
def cqf_merge(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem", "l_suppkey", "l_orderkey")
    return mem.cqf_merge([mem.cqf(items.where(F.col("l_orderkey") % 2 == i), "l_suppkey") for i in (0, 1)])


@query("SELECT count(*) AS asked, count(*) AS members FROM customer")
def cuckoo_member(spark: SparkSession, sf: str) -> DataFrame:
    keys = read(spark, sf, "customer", "c_custkey")
    return mem.cuckoo_member(mem.cuckoo(keys, "c_custkey", bits=16), keys, "c_custkey", bits=16).agg(F.count("*").alias("asked"), F.count(F.when(F.col("member"), 1)).alias("members"))


@query("SELECT count(*) FILTER (WHERE c_custkey % 2 = 0) AS left_over FROM customer")
def cuckoo_delete(spark: SparkSession, sf: str) -> DataFrame:
    keys = read(spark, sf, "customer", "c_custkey")
    return mem.cuckoo_delete(mem.cuckoo(keys, "c_custkey", bits=16), keys.where("c_custkey % 2 = 1"), "c_custkey", bits=16).agg(F.sum("count").alias("left_over"))


@query("SELECT count(*) AS asked, count(*) AS members FROM part")
def xor_no_false_negatives(spark: SparkSession, sf: str) -> DataFrame:
    keys = read(spark, sf, "part", "p_partkey")
    return mem.xor_member(mem.xor_build(keys, "p_partkey"), keys, "p_partkey").agg(F.count("*").alias("asked"), F.count(F.when(F.col("member"), 1)).alias("members"))


@query("SELECT true AS within")
def xor_fpr(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.range(0, 20_000).toDF("k")
    return mem.xor_member(mem.xor_build(keys, "k"), spark.range(20_000, 70_000).toDF("k"), "k").agg((F.avg(F.col("member").cast("double")) < 0.01).alias("within"))


@query("SELECT count(*) AS asked, CAST(0 AS BIGINT) AS missed, true AS few_wrong FROM customer")
def filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The chain's own answers, a Bloom, a quotient and a Xor stage: no member is missed, at most 1 % of the others pass."""
    keys = read(spark, sf, "customer", "c_custkey")
    chain = mem.FilterChain().add(mem.stage("bloom", keys, "c_custkey", capacity=1 << 18, fpr=1e-9)).add(mem.stage("quotient", keys.where("c_custkey % 2 = 0"), "c_custkey", q=28, r=32)).add(mem.stage("xor", keys.where("c_custkey % 3 = 0"), "c_custkey", bits=16))
    told = chain.member(keys, "c_custkey")
    truth = (F.col("c_custkey") % 2 == 0) & (F.col("c_custkey") % 3 == 0)
    return told.agg(F.count("*").alias("asked"), F.count(F.when(truth & ~F.col("member"), 1)).alias("missed"), (F.count(F.when(~truth & F.col("member"), 1)) <= 0.01 * F.count("*")).alias("few_wrong"))


@query("SELECT l_suppkey, count(*) AS estimate FROM lineitem GROUP BY ALL")
def cqf_estimate(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem", "l_suppkey")
    return mem.cqf_count(mem.cqf(items, "l_suppkey", q=28, r=32), items, "l_suppkey", q=28, r=32)


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS duplicate FROM documents")
def doc_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Texts counted twice in a wide counting quotient filter."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    state = mem.cqf(docs, "text", q=28, r=32)
    return docs.select("doc_id", *mem._quotient(hash64("text"), 28, 32)).join(state, ["q", "r"]).select("doc_id", (F.col("count") > 1).alias("duplicate"))


# --- reconciliation ----------------------------------------------------------------------------


@query()
def iblt_list_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Two replicas that each miss some orders, told apart from their tables' difference, in as many tables as it takes."""
    from .functions.hashing import unsigned

    orders = read(spark, sf, "orders", "o_orderkey")
    a, b = orders.where("o_orderkey % 103 <> 1"), orders.where("o_orderkey % 101 <> 0")
    return rec.iblt_difference(a, b, "o_orderkey", cells=20_000).select("side", unsigned(F.col("key_hash")).cast("string").alias("hash"))


ORACLE_SQL["iblt_list_entries"] = f"SELECT CAST(1 AS INTEGER) AS side, CAST({_h('o_orderkey')} AS VARCHAR) AS hash FROM orders WHERE o_orderkey % 101 = 0 AND o_orderkey % 103 <> 1 UNION ALL SELECT CAST(-1 AS INTEGER), CAST({_h('o_orderkey')} AS VARCHAR) FROM orders WHERE o_orderkey % 103 = 1 AND o_orderkey % 101 <> 0"


@query(f"SELECT CAST(3 * count(*) AS BIGINT) AS counts, CAST(bit_xor({_h('o_orderkey')}) AS VARCHAR) AS keys FROM orders")
def iblt_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Three cells a key: the counts add up, and the xor of all cells' keys is that of the keys (three times each)."""
    from .functions.hashing import unsigned

    cells = rec.iblt(read(spark, sf, "orders", "o_orderkey"), "o_orderkey", cells=5000)
    return cells.agg(F.sum("count").alias("counts"), unsigned(F.bit_xor("key_sum")).cast("string").alias("keys"))


@query("SELECT CAST(0 AS BIGINT) AS left_over")
def iblt_subtract(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders", "o_orderkey")
    halves = rec.iblt_merge([rec.iblt(orders.where(F.col("o_orderkey") % 2 == i), "o_orderkey") for i in (0, 1)])
    return rec.iblt_subtract(halves, rec.iblt(orders, "o_orderkey")).where("count <> 0 OR key_sum <> 0 OR check_sum <> 0").agg(F.count("*").alias("left_over"))


@query("SELECT o_orderkey % 2 = 0 AS kept, count(*) AS asked, CAST(0 AS BIGINT) AS missed FROM orders GROUP BY ALL")
def iblt_member_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    """All orders are put and the odd ones deleted: none of the even ones is missed."""
    keys = read(spark, sf, "orders", "o_orderkey")
    odd = keys.where("o_orderkey % 2 = 1")
    state = rec.iblt_merge([rec.iblt(keys, "o_orderkey", cells=1 << 18), rec.iblt(odd, "o_orderkey", cells=1 << 18, sign=-1)])
    told = rec.iblt_member(state, keys, "o_orderkey", cells=1 << 18).withColumn("kept", F.col("o_orderkey") % 2 == 0)
    return told.groupBy("kept").agg(F.count("*").alias("asked"), F.count(F.when(F.col("kept") & ~F.col("member"), 1)).alias("missed"))


# --- hashes and frames -------------------------------------------------------------------------


@query(f"SELECT c_custkey, CAST({_h('c_custkey')} AS VARCHAR) AS hash FROM customer")
def hash64_md5(spark: SparkSession, sf: str) -> DataFrame:
    from .functions.hashing import unsigned

    return read(spark, sf, "customer", "c_custkey").select("c_custkey", unsigned(hash64("c_custkey")).cast("string").alias("hash"))


# fixed values, published for these inputs: 0xCBD8A7B341BD9B02, 0xE3069283 and 0x2D06800538D394C2
@query("SELECT CAST(-3758069500696749310 AS BIGINT) AS murmur3, CAST(3808858755 AS BIGINT) AS crc32c, CAST(3244421341483603138 AS BIGINT) AS xxh3")
def hash_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Murmur3 of "hello" and XXH3 of "" as BIGINTs, and CRC-32C of "123456789"."""
    crc = F.udf(lambda raw: codec.crc32c(bytes(raw)), "long")
    return spark.range(1).select(hash64(F.lit("hello"), "murmur3").alias("murmur3"), crc(F.lit("123456789").cast("binary")).alias("crc32c"), hash64(F.lit(""), "xxh3").alias("xxh3"))


@query("SELECT event_type, true AS same FROM events GROUP BY event_type")
def codec_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """States in frames, written to a BINARY column and read back."""

    @F.udf("binary")
    def pack(rows: list) -> bytes:
        return codec.encode(codec.Frame("hll", bytes((14, 1)), codec.hll_state({r["bucket"]: r["value"] for r in rows}, 14), "xxh3"))

    @F.udf("long")
    def registers(raw: bytes) -> int:
        return sum(map(bool, codec.decode(bytes(raw)).state[4:]))

    state = card.hll(read(spark, sf, "events", "event_type", "user_id"), "user_id", ["event_type"])
    frames = state.groupBy("event_type").agg(F.count("*").alias("n"), F.collect_list(F.struct("bucket", "value")).alias("rows"))
    return frames.select("event_type", "n", pack("rows").alias("frame")).select("event_type", (registers("frame") == F.col("n")).alias("same"))


@query("SELECT f.family, CAST(0 AS BIGINT) AS differences FROM (VALUES ('bloom'), ('cms'), ('cqf'), ('cuckoo'), ('ddsketch'), ('frequent_items'), ('iblt'), ('misra_gries'), ('quotient'), ('theta')) f(family)")
def state_frames(spark: SparkSession, sf: str) -> DataFrame:
    """State rows of each family, packed into frames and read back: rows that differ."""
    from functools import reduce

    events, keys = read(spark, sf, "events", "event_type", "user_id", "value"), read(spark, sf, "orders", "o_orderkey")
    by = ["event_type"]
    rows = {
        "cms": (freq.cms(events, "user_id", by), by, {}),
        "theta": (card.theta_merge([card.theta(events, "user_id", by, k=64)], by, k=64), by, {"k": 64}),
        "ddsketch": (quant.ddsketch(events, "value", by), by, {}),
        "frequent_items": (freq.frequent_items(events, "user_id", by), by, {}),
        "misra_gries": (freq.misra_gries(events, "user_id", by), by, {}),
        "bloom": (mem.bloom(keys, "o_orderkey", 200_000), [], {"capacity": 200_000}),
        "quotient": (mem.quotient(keys, "o_orderkey", 18, 12), [], {"q": 18, "r": 12}),
        "cqf": (mem.cqf(keys, "o_orderkey", 18, 12), [], {"q": 18, "r": 12}),
        "cuckoo": (mem.cuckoo(keys, "o_orderkey", 200_000, 16), [], {"capacity": 200_000, "bits": 16}),
        "iblt": (rec.iblt(keys, "o_orderkey", cells=5000), [], {"cells": 5000}),
    }

    def differences(family: str) -> DataFrame:
        state, group, options = rows[family]
        state = state.drop("low", "high") if family != "ddsketch" else state
        again = states.from_frames(states.to_frames(state, family, group, **options), family, group)
        names = [c for c in state.columns if c not in ("low", "high")]
        both = state.select(*names, F.lit(1).alias("_s")).unionByName(again.select(*(F.col(c).cast(state.schema[c].dataType) for c in names), F.lit(-1).alias("_s")))
        odd = both.groupBy(*names).agg(F.sum("_s").alias("_s")).where("_s <> 0")
        return odd.agg(F.count("*").alias("differences")).select(F.lit(family).alias("family"), "differences")

    return reduce(DataFrame.unionByName, (differences(f) for f in sorted(rows)))
