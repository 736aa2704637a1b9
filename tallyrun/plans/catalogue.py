"""The queries that prove the operators, each with the SQL that must agree with it.

Every query opens a fresh store below the session's shared folder, drives the engine over the
whole tables and returns what it reads back. Times come from a clock that ticks a second a
look, so that orders are certain. Those without SQL are checked in the tests.
"""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import table_digest
from ..operators.relational import as_of, keep_first, newest_per_group, older_per_group, stacked, with_any, without_any
from ..operators.sampling import percent_sample
from ..names import StoreError
from ..refs import AsOf, File, Hash, Label, Run, Sql, Variant
from ..sources.datasource import StoreSource
from ..store import Store
from ..sweeps import binds, envelopes, variants_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Ticking:
    def __init__(self):
        self.at = datetime(2024, 1, 1)

    def __call__(self) -> datetime:
        self.at += timedelta(seconds=1)
        return self.at


def fresh_store(spark: SparkSession, **options) -> Store:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="tallyrun-")
    return Store(spark, f"{folder}/store-{uuid.uuid4().hex}", clock=Ticking(), **options)


def query(sql: str | None = None):
    """Register a function of (store, tables) under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(fresh_store(spark), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def money(column) -> F.Column:
    return F.round(column, 2)


# --- versions ------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(store, table):
    """A snapshot of lineitem, read back and summarised."""
    store.stow(table("lineitem"), "lineitem", shape="versioned")
    rows = store.grab("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(money(F.sum("l_quantity")).alias("sum_qty"), money(revenue).alias("revenue"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n"))


def _written(store, df, kind, name):
    path = store.files.path("inputs", f"{name}.{kind}")
    w = df.coalesce(1).write
    w.parquet(path) if kind in ("parquet", "pq") else w.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    return path


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def file_ingest_csv(store, table):
    path = _written(store, table("nation"), "csv", "nation")
    store.stow(File(path), "nation")
    return store.grab("nation", source=path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 3")
def file_ingest_tsv(store, table):
    store.ingest("nation", _written(store, table("nation").where("n_regionkey < 3"), "tsv", "nation"))
    return store.grab("nation")


@query("SELECT * FROM supplier")
def file_ingest_parquet(store, table):
    """grab(source=) reads the file first, and again only once it has changed."""
    path = _written(store, table("supplier"), "parquet", "supplier")
    store.grab("supplier", source=path)
    store.grab("supplier", source=path)
    assert len(store.log.of_name("supplier")) == 1
    return store.grab("supplier")


def _orders(table, status):
    return table("orders").where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = '{}'"


@query(ORDERS.format("O"))
def latest_version(store, table):
    store.stow(_orders(table, "F"), "orders", shape="versioned")
    store.stow(_orders(table, "O"), "orders", shape="versioned")
    return store.grab("orders")


@query(ORDERS.format("O"))
def restow_old_is_not_latest(store, table):
    """Writing old content again only moves its last_seen."""
    for status in "FOF":
        store.stow(_orders(table, status), "orders", shape="versioned")
    return store.grab("orders")


def _three_runs(store, table):
    runs = []
    for status in "FOP":
        runs.append(store.launch(lambda ctx, status=status: ctx.stow(_orders(table, status), "orders", shape="versioned"), label=f"status {status}", text=f"orders {status}"))
    return runs


@query(ORDERS.format("F"))
def version_by_hash(store, table):
    _three_runs(store, table)
    return store.grab("orders", version=store.log.of_name("orders")[0]["content_hash"])


@query(ORDERS.format("O"))
def from_run(store, table):
    return store.grab("orders", from_run=_three_runs(store, table)[1])


@query(ORDERS.format("O"))
def as_of_time(store, table):
    _three_runs(store, table)
    return store.grab("orders", as_of=store.log.of_name("orders")[1]["first_seen"])


@query(ORDERS.format("F"))
def variant(store, table):
    _three_runs(store, table)
    return store.grab("orders", variant="status F")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1")
def all_versions_union(store, table):
    _three_runs(store, table)
    both = stacked(list(store.grab("orders", run="all").values()))
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"), money(F.sum("o_totalprice")).alias("total"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def objects_and_tables(store, table):
    """An object written by one step picks the rows of another."""
    names = {r.r_regionkey: r.r_name for r in table("region").collect()}
    store.stow({str(k): v for k, v in names.items()}, "regions")
    store.stow(table("nation"), "nation", shape="versioned")
    found = store.grab("regions")
    mapping = F.create_map(*[F.lit(x) for k, v in found.items() for x in (int(k), v)])
    return store.grab("nation").select("n_name", mapping[F.col("n_regionkey")].alias("r_name"))


# --- append tables -------------------------------------------------------------------------


def _monthly(table, year):
    rows = table("orders").where(F.year("o_orderdate") == year)
    return rows.groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), money(F.sum("o_totalprice")).alias("total"))


def _append_years(store, table, years=(1995, 1996, 1997)):
    return [store.launch(lambda ctx, y=y: ctx.stow(_monthly(table, y), "months"), label=f"year {y}", text=f"months {y}") for y in years]


MONTHS = "SELECT month(o_orderdate)::INTEGER AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) {} GROUP BY {}"


@query("SELECT 'year ' || year(o_orderdate) AS variant_label, month(o_orderdate)::INTEGER AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY year(o_orderdate), month(o_orderdate)")
def append_all(store, table):
    _append_years(store, table)
    return store.grab("months", run="all").drop("run_id")


@query(MONTHS.format("= 1997", "1"))
def append_latest(store, table):
    _append_years(store, table)
    return store.grab("months")


@query(MONTHS.format("= 1996", "1"))
def append_run(store, table):
    return store.grab("months", run=_append_years(store, table)[1])


@query(MONTHS.format("= 1995", "1"))
def append_variant(store, table):
    _append_years(store, table)
    return store.grab("months", variant="year 1995")


@query("SELECT 'before' AS stage, 0::BIGINT AS n UNION ALL SELECT 'after', count(DISTINCT month(o_orderdate)) FROM orders WHERE year(o_orderdate) = 1998")
def append_current_run(store, table):
    """Within a step an append table is what the step itself has added."""
    _append_years(store, table)

    def step(ctx):
        before = ctx.grab("months").count()
        ctx.stow(_monthly(table, 1998), "months")
        ctx.stow([before, ctx.grab("months").count()], "counts")

    store.launch(step)
    before, after = store.grab("counts")
    return store.spark.createDataFrame([("before", before), ("after", after)], "stage string, n long")


@query("SELECT p_brand, n, NULL::DOUBLE AS price FROM (SELECT p_brand, count(*) AS n FROM part WHERE p_size <= 10 GROUP BY 1) UNION ALL SELECT p_brand, count(*), round(sum(p_retailprice), 2) FROM part WHERE p_size > 10 GROUP BY 1")
def drift_add_column(store, table):
    small, large = table("part").where("p_size <= 10"), table("part").where("p_size > 10")
    store.stow(small.groupBy("p_brand").agg(F.count("*").alias("n")), "brands")
    store.stow(large.groupBy("p_brand").agg(F.count("*").alias("n"), money(F.sum("p_retailprice")).alias("price")), "brands")
    return store.grab("brands", run="all").select("p_brand", "n", "price")


@query("SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part WHERE p_size <= 10 GROUP BY 1 UNION ALL SELECT p_brand, NULL, round(sum(p_retailprice), 2) FROM part WHERE p_size > 10 GROUP BY 1")
def drift_missing_column(store, table):
    small, large = table("part").where("p_size <= 10"), table("part").where("p_size > 10")
    store.stow(small.groupBy("p_brand").agg(F.count("*").alias("n"), money(F.sum("p_retailprice")).alias("price")), "brands")
    store.stow(large.groupBy("p_brand").agg(money(F.sum("p_retailprice")).alias("price")), "brands")
    return store.grab("brands", run="all").select("p_brand", "n", "price")


@query("SELECT n_name, n_regionkey::VARCHAR AS region FROM nation UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def drift_to_text(store, table):
    """A column that comes with another type becomes text."""
    nation, region = table("nation"), table("region")
    store.stow(nation.select("n_name", F.col("n_regionkey").alias("region")), "places")
    store.stow(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", F.col("r_name").alias("region")), "places")
    return store.grab("places", run="all").select("n_name", "region")


def _lists(table, year: int, *fields: str) -> DataFrame:
    """The orders of each customer in a year as a list of structs with the given fields."""
    found = table("orders").where(F.year("o_orderdate") == year)
    return found.groupBy("o_custkey").agg(F.collect_list(F.struct(*fields)).alias("bought"))


@query("""SELECT o_custkey, o_orderkey, CASE WHEN year(o_orderdate) = 1996 THEN o_orderstatus END AS o_orderstatus, CASE WHEN year(o_orderdate) = 1996 THEN o_orderpriority END AS o_orderpriority
FROM orders WHERE year(o_orderdate) IN (1995, 1996)""")
def append_nested(store, table):
    """Lists of structs are appended; the second lot has two more fields, which the first lacks when both are read."""
    store.stow(_lists(table, 1995, "o_orderkey"), "bought")
    store.stow(_lists(table, 1996, "o_orderpriority", "o_orderkey", "o_orderstatus"), "bought")
    again = Store(store.spark, store.files.root).grab("bought", run="all")
    return again.select("o_custkey", F.inline("bought")).select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT c_custkey, 'segment' AS key, c_mktsegment AS value, c_nationkey::VARCHAR AS place FROM customer
UNION ALL SELECT c_custkey, 'segment', c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def drift_nested_to_text(store, table):
    """A field within a map's values that comes with another type becomes text; the fields beside it stay."""
    customer = table("customer")
    named = customer.join(table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    for rows, place in ((customer, "c_nationkey"), (named, "n_name")):
        about = F.create_map(F.lit("segment"), F.struct(F.col("c_mktsegment").alias("value"), F.col(place).alias("place")))
        store.stow(rows.select("c_custkey", about.alias("about")), "customers")
    found = store.grab("customers", run="all").select("c_custkey", F.explode("about").alias("key", "of"))
    return found.select("c_custkey", "key", "of.value", "of.place")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def append_names_in_other_case(store, table):
    """A column whose name comes in other letters is the same column, as it is in the session's SQL."""
    first, second = (_orders(table, s).select("o_orderkey", "o_totalprice") for s in "FO")
    store.stow(first, "prices")
    store.stow(second.select(F.col("o_totalprice").alias("O_TotalPrice"), F.col("o_orderkey").alias("O_ORDERKEY")), "prices")
    return store.grab("prices", run="all").select("o_orderkey", "o_totalprice")


# --- views and SQL steps -------------------------------------------------------------------


@query("""SELECT f.fold, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, (VALUES (1, 1995, 1997), (2, 1996, 1998), (3, 1997, 1999)) AS f(fold, first, last)
WHERE year(o_orderdate) BETWEEN f.first AND f.last GROUP BY 1""")
def view_rolling_fold(store, table):
    """One view of a panel for each fold, swept over its years."""
    store.stow(table("orders"), "panel", shape="versioned")
    for fold, (first, last) in enumerate([(1995, 1997), (1996, 1998), (1997, 1999)], 1):
        store.stow(Sql(f"SELECT {fold} AS fold, o_totalprice FROM panel WHERE year(o_orderdate) BETWEEN {first} AND {last}"), "train", shape="view")
        store.launch(lambda ctx: ctx.stow(ctx.grab("train").groupBy("fold").agg(F.count("*").alias("n"), money(F.sum("o_totalprice")).alias("total")), "folds"), label=f"fold {fold}", text=f"fold {fold}")
    return store.grab("folds", run="all").select("fold", "n", "total")


REVENUE = "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"


@query(REVENUE)
def sql_view(store, table):
    for name in ("customer", "orders"):
        store.stow(table(name), name, shape="versioned")
    store.launch(Sql(f"-- @inputs: customer, orders\n-- @output: revenue\n{REVENUE};"))
    return store.grab("revenue")


@query(REVENUE)
def sql_table(store, table):
    for name in ("customer", "orders"):
        store.stow(table(name), name, shape="versioned")
    store.launch(Sql(f"-- @inputs: customer, orders\n-- @output: revenue\n{REVENUE}"), materialize=True)
    return store.grab("revenue")


CTE = "WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey), named AS (SELECT c_name, top FROM big JOIN customer ON c_custkey = o_custkey) SELECT c_name, top FROM named WHERE top > 300000"


@query(CTE)
def sql_cte(store, table):
    for name in ("customer", "orders"):
        store.stow(table(name), name, shape="versioned")
    store.launch(Sql(f"-- @inputs: customer, orders\n-- @output: big_customers\n{CTE}"))
    return store.grab("big_customers")


LAG = "SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events"


@query(LAG)
def sql_lag(store, table):
    store.stow(table("events"), "events", shape="versioned")
    store.launch(Sql(f"-- @inputs: events\n-- @output: steps_back\n{LAG}"), materialize=True)
    return store.grab("steps_back")


@query("SELECT 'O' AS panel, count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def sql_rebind(store, table):
    """A SQL step on an older version; a column named like its input is left alone."""
    for status in "FO":
        store.stow(_orders(table, status), "panel", shape="versioned")
    first = store.log.of_name("panel")[0]["content_hash"]
    store.launch(Sql("-- @inputs: panel\n-- @output: counted\nSELECT 'O' AS panel, count(*) AS n FROM panel"), rebind={"panel": Hash(first)})
    return store.grab("counted")


@query(MONTHS.format("= 1996", "1"))
def sql_append_rebind(store, table):
    """A SQL step over a labelled run of an append table."""
    _append_years(store, table)
    store.launch(Sql("-- @inputs: months\n-- @output: chosen\nSELECT * FROM months"), rebind={"months": Variant("year 1996")})
    return store.grab("chosen")


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def function_view(store, table):
    """A view by a function is read again as it was bound when it was stored."""
    for name in ("nation", "region"):
        store.stow(table(name), name, shape="versioned")

    def counted(s):
        return s.grab("nation").join(s.grab("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))

    store.stow(counted, "per_region", shape="view")
    store.stow(table("nation").limit(1), "nation", shape="versioned")
    return Store(store.spark, store.files.root).grab("per_region")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def store_sql(store, table):
    store.stow(table("customer"), "customer", shape="versioned")
    return store.sql("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")


@query("SELECT 'customer' AS logical_name, 'table' AS kind, count(DISTINCT c_mktsegment) AS n FROM customer")
def metadata_sql(store, table):
    """A version for each segment of the customers."""
    for r in table("customer").select("c_mktsegment").distinct().collect():
        store.stow(table("customer").where(F.col("c_mktsegment") == r[0]), "customer", shape="versioned")
    return store.sql("SELECT logical_name, kind, count(*) AS n FROM _tr_versions GROUP BY 1, 2")


# --- joins, aggregates and windows that the store's own queries use ------------------------------


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def newest_run_per_key(store, table):
    return newest_per_group(table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_custkey, c_name, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders JOIN customer ON c_custkey = o_custkey) WHERE rn = 1")
def latest_run_join(store, table):
    newest = newest_per_group(table("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return newest.join(table("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_custkey", "c_name", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def label_semijoin(store, table):
    urgent = table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return with_any(table("customer"), urgent, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')")
def anti_unreferenced(store, table):
    urgent = table("orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return without_any(table("customer"), urgent, "c_custkey").select("c_custkey", "c_name")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), b AS (SELECT user_id, ts, max(event_id) AS bought, max_by(value, event_id) AS paid FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, p.ts, b.bought, b.paid FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.ts >= b.ts""")
def asof_lookup(store, table):
    """For every event the user's last purchase until then."""
    e = table("events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("bought"), F.col("value").alias("paid"))
    return as_of(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "ts", "bought", ["bought", "paid"])


@query("SELECT user_id, event_type, min(ts) AS first_run, max(ts) AS last_run, count(*) AS n_runs, arg_max(event_id, (ts, event_id)) AS latest_run_id FROM events GROUP BY 1, 2")
def variants_summary(store, table):
    return table("events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_run"), F.max("ts").alias("last_run"), F.count("*").alias("n_runs"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest_run_id"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn > 1")
def keep_latest_rn(store, table):
    return older_per_group(table("events"), ["user_id"], ["ts", "event_id"]).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn > 3")
def keep_n(store, table):
    return older_per_group(table("events"), ["user_id"], ["ts", "event_id"], keep=3).select("event_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_of_each(store, table):
    return keep_first(table("events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT c_nationkey, len(list(c_custkey)) AS n, list_sort(list(c_custkey))[1] AS first FROM customer GROUP BY 1")
def producers_list(store, table):
    """Group to list, as versions() does with the runs that made each."""
    grouped = table("customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("all"))
    return grouped.select("c_nationkey", F.size("all").cast("long").alias("n"), F.col("all")[0].alias("first"))


@query("SELECT DISTINCT o_orderstatus AS upstream_label, o_orderstatus = 'O' AS used FROM orders")
def unexplored(store, table):
    """Which labelled versions a script has read."""
    for status in _statuses(table):
        store.launch(lambda ctx, s=status: ctx.stow(_orders(table, s), "orders", shape="versioned"), label=status, text=f"orders {status}")
    store.launch(lambda ctx: ctx.stow(ctx.grab("orders", variant="O").count(), "counted"), text="count orders")
    script = next(r["step"] for r in store.log.runs.values() if r["inputs"])
    return store.variants_unexplored(script).select("upstream_label", F.col("used_by_this_script").alias("used"))


@query("SELECT o_orderstatus AS step_label, 1::BIGINT AS n_runs FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1")
def variants_of_a_name(store, table):
    _three_runs(store, table)
    return store.variants(name="orders").select(F.substring("variant_label", 8, 1).alias("step_label"), "n_runs")


@query("SELECT r_regionkey::INTEGER AS k, r_regionkey <> 2 AS is_rebind FROM region WHERE r_regionkey IN (1, 2, 3)")
def versions_with_rebinds(store, table):
    """Values bound for a run are versions that newest reads don't see."""
    store.stow(table("region").where("r_regionkey = 2"), "rows", shape="versioned")
    for k in (1, 3):
        store.launch(lambda ctx: ctx.stow(ctx.grab("rows").count(), "n"), rebind={"rows": table("region").where(F.col("r_regionkey") == k)}, text="count rows", force=True)
    found = [(store.value_of(v).first().r_regionkey, bool(v["is_rebind"])) for v in store.log.of_name("rows", rebinds=True)]
    assert store.versions("rows").count() == 3 and store.versions("rows", include_rebinds=False).count() == 1
    return store.spark.createDataFrame(found, "k int, is_rebind boolean")


# --- hashing and sampling ----------------------------------------------------------------------


@query("""SELECT x.changed AS changed, CASE x.changed WHEN 'columns and rows in another order' THEN count(*) WHEN 'a row twice' THEN count(*) + 1 ELSE 2 * count(*) END::BIGINT AS n, x.changed = 'columns and rows in another order' AS same
FROM part, (VALUES ('columns and rows in another order'), ('a row twice'), ('a type'), ('a null moved')) x(changed) GROUP BY 1""")
def content_hash_groups(store, table):
    """What a table's hash tells apart."""
    part = table("part")
    nulls = part.select("p_partkey", F.lit(None).cast("string").alias("a"), F.lit("x").alias("b"))
    moved = part.select("p_partkey", F.lit("x").alias("a"), F.lit(None).cast("string").alias("b"))
    typed = part.withColumn("p_size", F.col("p_size").cast("long"))
    pairs = {"columns and rows in another order": (part, part.select(*reversed(part.columns)).repartition(7)), "a row twice": (part, part.union(part.limit(1))), "a type": (part, typed), "a null moved": (nulls, moved)}
    rows = []
    for changed, (one, other) in pairs.items():
        (first, n), (second, m) = table_digest(one), table_digest(other)
        rows.append((changed, m if changed in ("columns and rows in another order", "a row twice") else n + m, first == second))
    return store.spark.createDataFrame(rows, "changed string, n long, same boolean")


# --- sampling ------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, count(*) AS again FROM (SELECT * FROM customer LIMIT 60)")
def seeded_sample(store, table):
    """The same rows for the same seed, however they are dealt out; other rows for another."""

    def drawn(seed, parts):
        store.launch(lambda ctx: ctx.stow(ctx.sample(table("customer").repartition(parts), 60, ["c_custkey"]), "drawn", shape="versioned"), seed=seed, force=True, text="draw")
        return store.grab("drawn")

    first, again, other = drawn(0.5, 3), drawn(0.5, 8), drawn(-0.5, 3)
    assert other.join(first, "c_custkey", "left_anti").count()
    return first.join(again, "c_custkey", "left_semi").agg(F.count("*").alias("again")).withColumn("n", F.lit(first.count()))


@query("SELECT p.percent::DOUBLE AS percent, floor(count(*) * p.percent / 100 + 0.5)::BIGINT AS n, floor(count(*) * p.percent / 100 + 0.5)::BIGINT AS again FROM events, (VALUES (0.5), (20), (75)) p(percent) GROUP BY p.percent")
def percent_sample_is_stable(store, table):
    """Shares of the events are exact, and the same rows however they are dealt out."""
    events, found = table("events"), []
    for percent in (0.5, 20.0, 75.0):
        one, two = percent_sample(events, percent, 0.1, ["event_id"]), percent_sample(events.repartition(9), percent, 0.1, ["event_id"])
        found.append((percent, one.count(), one.select("event_id").intersect(two.select("event_id")).count()))
    return store.spark.createDataFrame(found, "percent double, n long, again long")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), b AS (SELECT event_id % 2 AS side, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS bought FROM events WHERE event_type = 'purchase' GROUP BY event_id % 2, ts)
SELECT p.event_id, b.bought FROM p ASOF LEFT JOIN b ON p.event_id % 2 = b.side AND p.ts >= b.ts""")
def asof_heavy_keys(store, table):
    """The last purchase among all events of the same parity: two keys that have all rows, split into ranges of time."""
    e = table("events").withColumn("side", F.col("event_id") % 2)
    bought = e.where("event_type = 'purchase'").select("side", "ts", F.col("event_id").alias("bought"))
    asked = e.where("event_type <> 'purchase'").select("event_id", "side", "ts")
    return as_of(asked, bought, ["side"], "ts", "ts", "bought", ["bought"], split_rows=500).select("event_id", "bought")


# --- sweeps, queue, freshness, pruning ------------------------------------------------------------


def _count_orders(table):
    def step(ctx):
        status, least = ctx.grab("status"), ctx.grab("least")
        n = table("orders").where((F.col("o_orderstatus") == status) & (F.col("o_totalprice") >= least))
        ctx.stow(n.agg(F.lit(status).alias("status"), F.lit(least).cast("long").alias("least"), F.count("*").alias("n")), "counts")

    return step


@query("SELECT s.status AS status, l.least::BIGINT AS least, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P')) s(status) CROSS JOIN (VALUES (0), (100000)) l(least) LEFT JOIN orders ON o_orderstatus = s.status AND o_totalprice >= l.least GROUP BY 1, 2")
def sweep_cross(store, table):
    store.launch(_count_orders(table), rebind=binds(mode="cross", status=["F", "O", "P"], least=[0, 100000]), text="count")
    return store.grab("counts", run="all").select("status", "least", "n")


@query("SELECT s.status AS status, s.least::BIGINT AS least, count(o_orderkey) AS n FROM (VALUES ('F', 50000), ('O', 60000), ('P', 70000)) s(status, least) LEFT JOIN orders ON o_orderstatus = s.status AND o_totalprice >= s.least GROUP BY 1, 2")
def sweep_zip(store, table):
    store.launch(_count_orders(table), rebind=binds(status=["F", "O", "P"], least=[50000, 60000, 70000], labels=["f", "o", "p"]), text="count")
    return store.grab("counts", run="all").select("status", "least", "n")


@query("SELECT s.status AS status, count(o_orderkey) AS n FROM (VALUES ('O'), ('P')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1")
def sweep_variants(store, table):
    """A sweep over labelled versions, one envelope written by hand."""
    _three_runs(store, table)
    step = lambda ctx: ctx.stow(ctx.grab("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), "counts")
    store.launch(step, rebind=binds(orders=variants_of("status O")), text="count versions")
    store.launch(step, rebind=envelopes({"orders": Variant("status P"), ".label": "p"}), text="count versions")
    return store.grab("counts", run="all").select("status", "n")


@query("""WITH folds AS (SELECT k AS fold, s.segment, avg(c_acctbal) AS score FROM customer, (SELECT unnest(range(0, 5)) AS k), (VALUES ('BUILDING'), ('MACHINERY')) s(segment) WHERE c_mktsegment = s.segment AND c_custkey % 5 <> k GROUP BY 1, 2)
SELECT segment, count(*) AS n, round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS sd FROM folds GROUP BY 1""")
def cv_summary(store, table):
    """A score for each fold and segment, summarised over the append table that the sweep fills."""

    def step(ctx):
        fold, segment = ctx.grab("fold"), ctx.grab("segment")
        rows = table("customer").where((F.col("c_mktsegment") == segment) & (F.col("c_custkey") % 5 != fold))
        ctx.stow(rows.agg(F.lit(fold).alias("fold"), F.lit(segment).alias("segment"), F.avg("c_acctbal").alias("score")), "scores")

    store.launch(step, rebind=binds(mode="cross", fold=range(5), segment=["BUILDING", "MACHINERY"]), text="score")
    return store.grab("scores", run="all").groupBy("segment").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.stddev_samp("score"), 4).alias("sd"))


@query("SELECT * FROM region WHERE r_regionkey < 2")
def rebind_literal_not_latest(store, table):
    store.stow(table("region").where("r_regionkey < 2"), "region", shape="versioned")
    store.launch(lambda ctx: ctx.stow(ctx.grab("region").count(), "n"), rebind={"region": table("region")}, text="count")
    assert store.grab("n") == 5
    return store.grab("region")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def rebind_as_of(store, table):
    _three_runs(store, table)
    at = store.log.of_name("orders")[0]["first_seen"]
    store.launch(lambda ctx: ctx.stow(ctx.grab("orders").agg(F.count("*").alias("n")), "n", shape="versioned"), rebind={"orders": AsOf(at)}, text="count")
    return store.grab("n")


_STAGED = "def staged(ctx):\n    rows = ctx.grab('orders').where(f\"o_totalprice < {ctx.grab('below')}\")\n    ctx.stow(rows.groupBy('o_orderstatus').count(), 'staged_counts')\n"


def _staged(ctx):
    rows = ctx.grab("orders").where(f"o_totalprice < {ctx.grab('below')}")
    ctx.stow(rows.groupBy("o_orderstatus").count(), "staged_counts")


@query("SELECT o_orderstatus, v.below::BIGINT AS below, count(*) AS n FROM orders, (VALUES (50000), (100000), (200000)) v(below) WHERE o_totalprice < v.below GROUP BY 1, 2")
def queue_pickup(store, table):
    """Runs over the orders staged as a sweep, picked up one by one; a staged one is also the template of another."""
    store.stow(table("orders"), "orders", shape="versioned")
    ids = store.queue(_staged, rebind=binds(below=[50000, 100000], labels=["50000", "100000"]), text=_STAGED)
    again = store.queue(_staged, rebind=binds(below=[50000, 100000], labels=["50000", "100000"]), text=_STAGED)
    assert ids == again
    store.launch(Run(ids[0]), rebind={"below": 200000}, label="200000")
    for i in ids:
        store.launch(Run(i))
    return store.grab("staged_counts", run="all").select("o_orderstatus", F.col("variant_label").cast("long").alias("below"), F.col("count").alias("n"))


@query("SELECT o_orderstatus, 150000::BIGINT AS below, count(*) AS n FROM orders WHERE o_totalprice < 150000 GROUP BY 1")
def lease_takeover(store, table):
    """A staged run whose process died after it had appended is done again from its start by another."""
    store.stow(table("orders"), "orders", shape="versioned")
    run = store.queue(_staged, rebind={"below": 150000}, label="150000", text=_STAGED)
    store.stow(table("orders").groupBy("o_orderstatus").count(), "staged_counts")
    left = store.log.chunks[-1]
    store.log.commit(lambda: [{"do": "run_update", "run_id": run, "set": {"status": "claimed", "lease": "of one that died", "lease_until": store.now()}}, {"do": "chunk_delete", "path": left["path"]}, {"do": "chunk_add", "chunk": left | {"run_id": run}}])
    other = Store(store.spark, store.files.root, clock=store._clock)
    other.launch(Run(run))
    return other.grab("staged_counts", run="all").where("variant_label is not null").select("o_orderstatus", F.col("variant_label").cast("long").alias("below"), F.col("count").alias("n"))


@query("SELECT s.status AS status, l.least::BIGINT AS least, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus AS status FROM orders) s CROSS JOIN (VALUES (0), (100000)) l(least) LEFT JOIN orders ON o_orderstatus = s.status AND o_totalprice >= l.least GROUP BY 1, 2")
def sweep_side_by_side(store, table):
    """The runs of a sweep three at a time have the rows that they have one by one."""
    store.launch(_count_orders(table), rebind=binds(mode="cross", status=_statuses(table), least=[0, 100000]), text="count", parallel=3)
    return store.grab("counts", run="all").select("status", "least", "n")


@query("SELECT x.status AS status, x.n::BIGINT AS n, (SELECT count(*) FROM region) AS rows FROM (VALUES ('success', 3), ('skipped_fresh', 2), ('interactive', 2)) x(status, n)")
def skip_fresh_counts(store, table):
    """A step runs once, is skipped twice, and runs again when its input or code changes."""
    step = lambda ctx: ctx.stow(ctx.grab("region").count(), "n")
    store.stow(table("region"), "region", shape="versioned")
    for _ in range(3):
        store.launch(step, text="count region")
    store.stow(table("region").limit(2), "region", shape="versioned")
    store.launch(step, text="count region")
    store.launch(step, text="count region differently")
    whole = max(store.grab("n", version=v["content_hash"]) for v in store.log.of_name("n"))
    return store.runs().groupBy("status").agg(F.count("*").alias("n")).withColumn("rows", F.lit(whole).cast("long"))


@query("SELECT count(*) AS n, 3::BIGINT AS runs FROM orders WHERE o_orderstatus = 'O'")
def relaunch_label(store, table):
    store.stow(_orders(table, "F"), "orders", shape="versioned")

    source = "def counted(ctx):\n    ctx.stow(ctx.grab('orders').selectExpr('count(*) AS n'), 'n', shape='versioned')\n"
    first = store.launch(lambda ctx: ctx.stow(ctx.grab("orders").selectExpr("count(*) AS n"), "n", shape="versioned"), label="base", text=source)
    store.stow(_orders(table, "O"), "orders", shape="versioned")
    store.launch(Label("base"))
    store.launch(Run(first), force=True)
    return store.grab("n").withColumn("runs", F.lit(store.runs().where("variant_label = 'base'").count()))


@query(MONTHS.format("= 1997", "1"))
def prune_keep(store, table):
    """Only the newest run's rows are left of an append table."""
    _append_years(store, table)
    store.prune("months", keep=1, force=True)
    return store.grab("months", run="all").select("month", "n", "total")


@query("SELECT DISTINCT 'year ' || year(o_orderdate) AS variant_label FROM orders WHERE year(o_orderdate) IN (1995, 1996)")
def prune_keep_latest_label(store, table):
    for y in (1995, 1996, 1995):
        store.launch(lambda ctx, y=y: ctx.stow(_monthly(table, y), "months"), label=f"year {y}", text=f"months {y}", force=True)
    store.prune("months", keep_latest=True)
    assert len(store.log.chunks_of("months")) == 2
    return store.grab("months", run="all").select("variant_label").distinct()


@query("SELECT 1::BIGINT AS left_over, count(*) - 1 AS removed FROM region")
def prune_versions(store, table):
    for low in range(table("region").count()):
        store.stow(table("region").where(F.col("r_regionkey") >= low), "region", shape="versioned")
    gone = store.prune("region", keep_latest=True, force=True)["versioned"].count()
    return store.spark.createDataFrame([(len(store.log.of_name("region")), gone)], "left_over long, removed long")


# --- listings, protection, labels and identity, over what the tables hold --------------------------


def _statuses(table) -> list[str]:
    return sorted(r[0] for r in table("orders").select("o_orderstatus").distinct().collect())


def _run_per_status(store, table, text: str = "orders of {}") -> None:
    for s in _statuses(table):
        store.launch(lambda ctx, s=s: ctx.stow(_orders(table, s), "orders", shape="versioned"), label=f"status {s}", text=text.format(s))


@query("SELECT row_number() OVER (ORDER BY o_orderstatus DESC) AS place, count(*) AS n, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END::BIGINT AS makers FROM orders GROUP BY o_orderstatus")
def versions_listing(store, table):
    """versions() names every version, the newest first, with all runs that made it."""
    _run_per_status(store, table)
    store.launch(lambda ctx: ctx.stow(_orders(table, "F"), "orders", shape="versioned"), text="orders of F once more")
    listed = store.versions("orders").collect()
    rows = [(k + 1, store.grab("orders", version=r.content_hash).count(), len(r.produced_by_runs)) for k, r in enumerate(listed)]
    return store.spark.createDataFrame(rows, "place long, n long, makers long")


@query("SELECT 'status ' || o_orderstatus AS variant_label, CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END::BIGINT AS n_runs, count(*) AS n FROM orders GROUP BY o_orderstatus")
def variants_listing(store, table):
    """variants() counts the runs of each label; the label gives the rows back."""
    _run_per_status(store, table)
    store.launch(lambda ctx: ctx.stow(_orders(table, "P"), "orders", shape="versioned"), label="status P", text="orders of P", force=True)
    found = [(r.variant_label, r.n_runs, store.grab("orders", variant=r.variant_label).count()) for r in store.variants(name="orders").collect()]
    return store.spark.createDataFrame(found, "variant_label string, n_runs long, n long")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def prune_protects(store, table):
    """Versions that runs have written stay unless force is set."""
    _run_per_status(store, table)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        gone = store.prune("orders", keep=1)["versioned"].count()
    assert gone == 0
    every = list(Store(store.spark, store.files.root).grab("orders", run="all").values())
    return stacked(every).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def prune_chunks_protects(store, table):
    """Of an append table the unlabelled runs go and the labelled stay."""
    for s in _statuses(table):
        store.launch(lambda ctx, s=s: ctx.stow(_orders(table, s), "orders"), label=None if s == "F" else f"status {s}", text=f"append {s}")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        store.prune("orders", keep=0)
    return store.grab("orders", run="all").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def label_propagation(store, table):
    """A step without a label has that of its inputs, so its result is found by it."""
    store.launch(lambda ctx: ctx.stow(_orders(table, "O"), "orders", shape="versioned"), label="open", text="open orders")
    store.launch(lambda ctx: ctx.stow(ctx.grab("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "counts", shape="versioned"), text="count them")
    store.stow(table("region"), "counts", shape="versioned")
    return store.grab("counts", variant="open")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def sql_batch(store, table):
    """A SQL step swept over labelled versions."""
    _run_per_status(store, table)
    step = Sql("-- @inputs: orders\n-- @output: totals\nSELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
    store.launch(step, rebind=binds(orders=variants_of(*[f"status {s}" for s in _statuses(table)])), materialize=True)
    return stacked(list(store.grab("totals", run="all").values()))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def discarded_runs(store, table):
    """Queued runs of a label are discarded; the others are picked up."""
    table("orders").createOrReplaceTempView("orders_to_stage")
    text = "def staged(ctx):\n    s = ctx.grab('status')\n    ctx.stow(ctx.spark.table('orders_to_stage').where(f\"o_orderstatus = '{s}'\").groupBy('o_orderstatus').count(), 'counts')\n"
    ids = [store.queue(_staged, rebind={"status": s}, label=f"status {s}", text=text) for s in _statuses(table)]
    gone = store.discard_queued(variant_label="status P")
    for i in ids:
        if i not in gone:
            store.launch(Run(i))
    return store.grab("counts", run="all").select("o_orderstatus", F.col("count").alias("n"))


@query("SELECT count(*) AS chunks, count(DISTINCT o_orderstatus) AS contents FROM (SELECT DISTINCT o_orderstatus, k FROM orders, range(2) r(k))")
def chunk_hashes(store, table):
    """Chunks of equal rows have equal hashes, in whatever order rows and columns come."""
    for s in _statuses(table):
        df = _orders(table, s)
        store.stow(df, "orders")
        store.stow(df.select(*reversed(df.columns)).repartition(3, "o_custkey"), "orders")
    return store.sql("SELECT count(*) AS chunks, count(DISTINCT chunk_hash) AS contents FROM _tr_append_chunks")


@query("SELECT CASE WHEN c_nationkey % 2 = 1 THEN 7 ELSE 0 END::INTEGER AS p, count(*) AS n, 2::BIGINT AS versions FROM customer GROUP BY 1")
def folder_source_change(store, table):
    """A partition that gets another name makes a second version of a folder."""
    folder = store.files.path("inputs", "customers.parquet")
    table("customer").withColumn("p", (F.col("c_nationkey") % 2).cast("int")).write.partitionBy("p").parquet(folder)
    store.grab("customer", source=folder)
    store.files.rename(f"{folder}/p=1", f"{folder}/p=7")
    now = store.grab("customer", source=folder)
    return now.groupBy("p").agg(F.count("*").alias("n")).withColumn("versions", F.lit(len(store.log.of_name("customer"))).cast("long"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def functions_by_their_values(store, table):
    """One function with other default values is another step, and is not skipped."""
    for s in _statuses(table):
        store.launch(lambda ctx, s=s: ctx.stow(_orders(table, s).groupBy("o_orderstatus").agg(F.count("*").alias("n")), "counts"))
    return store.grab("counts", run="all").select("o_orderstatus", "n")


_PRICED = """
from pyspark.sql import functions as F
LEAST = 100000

def least():
    return LEAST

def chosen(orders):
    return orders.where(F.col("o_totalprice") >= least())

def step(ctx):
    ctx.stow(chosen(ctx.grab("orders")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("decimal(20,2)").alias("total")), "counts")
"""


def _module(text: str):
    """A module of a text, whose source Python finds as it would that of a file."""
    import linecache
    import types

    place = f"<priced-{hash(text)}>"
    linecache.cache[place] = (len(text), None, text.splitlines(True), place)
    module = types.ModuleType("priced")
    exec(compile(text, place, "exec"), module.__dict__)
    return module


@query("""SELECT v.k, o_orderstatus, count(*) AS n, sum(o_totalprice)::DECIMAL(20, 2) AS total FROM orders, (VALUES (0, 100000, 1e12), (1, 200000, 1e12), (2, 400000, 1e12), (3, 0, 400000)) v(k, low, high)
WHERE o_totalprice >= v.low AND o_totalprice < v.high GROUP BY 1, 2""")
def steps_by_their_module(store, table):
    """An edited constant, an edited helper's helper and an edited helper each make a step run again; the step alone, or what it doesn't reach, does not."""
    store.stow(table("orders"), "orders", shape="versioned")
    edits = [("", ""), ("", "\nOTHER = 1\n"), ("LEAST = 100000", "LEAST = 200000"), ("return LEAST", "return LEAST * 2"), (">= least()", "< least()"), ("", "")]
    text, ran = _PRICED, []
    for old, new in edits:
        text = text.replace(old, new) if old else text + new
        ran.append(store.launch(_module(text).step))
    done = [i for i in ran if store.log.runs[i]["status"] == "success"]
    assert [store.log.runs[i]["status"] for i in ran].count("skipped_fresh") == 2
    return stacked([store.grab("counts", run=i).withColumn("k", F.lit(k)) for k, i in enumerate(done)])


@query("SELECT count(*) AS n, 1::BIGINT AS versions, count(*) AS again FROM lineitem")
def seeded_sql(store, table):
    """A seeded SQL step gives each row the same random number again; a clock or a sample without a seed of its own is refused."""
    store.stow(table("lineitem"), "lineitem", shape="versioned")
    step = Sql("-- @inputs: lineitem\n-- @output: marked\nSELECT l_orderkey, l_linenumber, rand() AS x FROM lineitem")
    for _ in range(2):
        store.launch(step, materialize=True, seed=0.5, force=True)
    for body in ("SELECT *, now() AS x FROM lineitem", "SELECT * FROM lineitem TABLESAMPLE (10 PERCENT)"):
        try:
            store.launch(Sql(f"-- @inputs: lineitem\n-- @output: refused\n{body}"), materialize=True, seed=0.5)
        except StoreError:
            continue
        raise AssertionError(f"not refused: {body}")
    other = Store(store.spark, f"{store.files.root}-again")
    other.stow(table("lineitem"), "lineitem", shape="versioned")
    other.launch(step, materialize=True, seed=0.5)
    keys = ["l_orderkey", "l_linenumber", "x"]
    same = store.grab("marked").select(keys).intersectAll(other.grab("marked").select(keys)).count()
    return store.grab("marked").agg(F.count("*").alias("n")).select("n", F.lit(len(store.log.of_name("marked"))).cast("long").alias("versions"), F.lit(same).cast("long").alias("again"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def append_by_two_writers(store, table):
    """Two stores append frames of different columns; each takes in what the other has changed."""
    other = Store(store.spark, store.files.root)
    for k, s in enumerate(_statuses(table)):
        (store, other)[k % 2].stow(_orders(table, s).withColumn(f"extra{k}", F.lit(k)), "orders")
    return Store(store.spark, store.files.root).grab("orders", run="all").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def published_views(store, table):
    """Latest views in the session's own catalog: what is committed after they were published shows in the session's SQL."""
    mark = f"v{uuid.uuid4().hex[:8]}_"
    store.stow(table("customer").limit(3), "customer", shape="versioned")
    store.stow(_orders(table, "F"), "orders")
    store.publish(prefix=mark)
    store.stow(table("customer"), "customer", shape="versioned")
    store.stow(_orders(table, "O"), "orders")
    return store.spark.sql(f"SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {mark}customer JOIN {mark}orders ON o_custkey = c_custkey GROUP BY 1")


@query("SELECT o_orderkey, o_totalprice, 'status ' || o_orderstatus AS variant_label FROM orders WHERE o_orderstatus IN ('F', 'O')")
def data_source(store, table):
    """All runs of an append table through the data source."""
    for s in "FO":
        store.launch(lambda ctx, s=s: ctx.stow(_orders(table, s).select("o_orderkey", "o_totalprice"), "orders"), label=f"status {s}", text=f"orders {s}")
    store.spark.dataSource.register(StoreSource)
    return store.spark.read.format("tallyrun").options(store=store.files.root, table="orders", run="all").load().drop("run_id")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000 AND c_nationkey <> 7")
def packed_chunks(store, table):
    """A run for each nation, packed into few files; a pruned run stays out, ranges skip files, other sessions read the same."""
    nations = sorted(r[0] for r in table("customer").select("c_nationkey").distinct().collect())
    rows = table("customer").select("c_nationkey", "c_custkey", "c_acctbal")
    ids = {n: store.launch(lambda ctx, n=n: ctx.stow(rows.where(F.col("c_nationkey") == n).coalesce(1), "customers"), text=f"nation {n}") for n in nations}
    store.compact("customers", file_bytes=20_000)
    store.prune("customers", run_id=ids[7], force=True)
    other = Store(store.spark, store.files.root)
    assert len(other.grab("customers", run=ids[3]).inputFiles()) == 1 and other.grab("customers", run=ids[7]).isEmpty()
    return other.grab("customers", run="all", between={"c_acctbal": (1000.0, 2000.0)}).select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def dropped_names(store, table):
    """A dropped name is gone for all and free for another shape."""
    store.stow(_orders(table, "F"), "orders", shape="versioned")
    store.drop("orders")
    other = Store(store.spark, store.files.root)
    assert not other.exists("orders")
    for s in _statuses(table):
        other.stow(_orders(table, s), "orders")
    assert store.exists("orders")
    return store.grab("orders", run="all").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# --- what users say in SQL over the store's tables ---------------------------------------------


def _said(name: str, tables: tuple[str, ...], spark_sql: str, sql: str | None = None):
    """A query of user SQL over stored tables; sql is the same for DuckDB where its dialect differs."""

    def run(store, table):
        for t in tables:
            store.stow(table(t), t, shape="versioned")
        return store.sql(spark_sql)

    run.__name__, run.__doc__ = name, f"User SQL over {', '.join(tables)}."
    query(sql or spark_sql)(run)


_said("user_joins", ("nation", "region", "supplier"), """SELECT r_name, n_name, s.n AS suppliers FROM region FULL JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM supplier x WHERE x.s_nationkey = n_nationkey AND x.s_acctbal > 0)""")
_said("user_theta_join", ("nation", "region"), "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_said("user_grouping_sets", ("orders",), "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
_said("user_rollup_cube", ("customer",), "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment) HAVING count(*) > 5")
_said("user_aggregates", ("lineitem",), "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, median(l_quantity) AS middle, count(*) FILTER (WHERE l_discount > 0.05) AS cheap, round(stddev_samp(l_tax), 6) AS sd FROM lineitem GROUP BY l_returnflag")
_said("user_windows", ("events",), """SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS q, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving,
nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""")
_said("user_set_operations", ("customer", "orders"), "(SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT -1")
_said("user_pivot", ("orders",), "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
      "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
_said("user_recursion", ("region",), "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, r_name FROM t JOIN region ON n % 5 = r_regionkey")
_said("user_strings_dates", ("part", "orders"), "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, extract(year FROM o_orderdate) AS y, lower(o_orderpriority) AS p, split_part(o_orderpriority, '-', 1) AS n FROM orders WHERE o_orderpriority LIKE '%U%' AND o_orderdate >= TIMESTAMP_NTZ '1998-01-01'",
      "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, extract(year FROM o_orderdate)::INTEGER AS y, lower(o_orderpriority) AS p, split_part(o_orderpriority, '-', 1) AS n FROM orders WHERE o_orderpriority LIKE '%U%' AND o_orderdate >= TIMESTAMP '1998-01-01'")
_said("user_arrays", ("embeddings",), "SELECT vec_id, size(embedding) AS n, size(filter(embedding, x -> x > 0)) AS positive, round(aggregate(embedding, 0D, (a, x) -> a + x), 4) AS total FROM embeddings",
      "SELECT vec_id, len(embedding)::INTEGER AS n, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS positive, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
_said("user_arg_max", ("orders",), "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY 1", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY 1")
_said("user_top_n", ("orders",), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 5")
