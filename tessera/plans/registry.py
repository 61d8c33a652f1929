"""The library's registered queries, one or more an operator, each with its SQL.

A query is (function, SQL); the function takes the loaded tables as attributes of ``t``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as R
from ..functions.predicates import JoinPredicate, Op, Predicate
from ..errors import TransactionAborted
from ..session import Engine
from ..ship import ship
from ..sources.heap import convert, read_heap, write_heap
from ..sources.scratch import new_folder
from ..sources.snapshot import Database
from ..sources.sorted_table import index_scan, write_sorted
from ..streaming import running_by_row
from .join_order import Input, JoinNode, join_cost, join_rows, order_joins
from .stats import TableStats, histogram


class Tables:
    """Tables of a data folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        self.__dict__[name] = df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df

    def scratch(self) -> str:
        """A new folder that driver and executors share."""
        return new_folder(self.spark, "scratch")

    def engine(self, **options) -> Engine:
        out = Engine(self.spark, **options)
        for name, key in _KEYS.items():
            out.register(name, lambda name=name: getattr(self, name), key)
        return out


_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": None,
}
Query = Callable[[Tables], DataFrame]
_ALL: dict[str, tuple[Query, str]] = {}


def _query(name: str, sql: str):
    def add(f: Query) -> Query:
        _ALL[name] = (f, sql)
        return f

    return add


def _plain(name: str, sql: str, f: Query) -> None:
    _ALL[name] = (f, sql)


def _where(df: DataFrame, *ps: tuple[str, str, object]) -> DataFrame:
    return R.filter_rows(df, *[Predicate(c, Op.parse(o), v) for c, o, v in ps])


def _on(left: str, op: str, right: str) -> JoinPredicate:
    return JoinPredicate(left, Op.parse(op), right)


# scans and filters
_plain("scan_region", "SELECT r_regionkey, r_name FROM region", lambda t: R.scan(t.region))
_plain(
    "scan_alias", 'SELECT r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM region', lambda t: R.scan(t.region, "r")
)
_PART = "SELECT p_partkey, p_name, p_size FROM part WHERE "
for _name, _op, _v in (("eq", "=", 10), ("neq", "<>", 10), ("gt", ">", 40), ("ge", ">=", 40), ("lt", "<", 10), ("le", "<=", 10)):
    _plain(
        f"filter_{_name}", f"{_PART} p_size {_op} {_v}",
        lambda t, o=_op, v=_v: R.project(_where(t.part, ("p_size", o, v)), ["p_partkey", "p_name", "p_size"]),
    )
_plain("filter_neq_string", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
       lambda t: R.project(_where(t.orders, ("o_orderstatus", "!=", "F")), ["o_orderkey", "o_orderstatus"]))
_plain("filter_like_contains", f"{_PART} contains(p_name, 'widget')",
       lambda t: R.project(_where(t.part, ("p_name", "LIKE", "widget")), ["p_partkey", "p_name", "p_size"]))
_plain("filter_like_literal", "SELECT n_nationkey, n_name FROM nation WHERE contains(n_name, 'N_1')",
       lambda t: R.project(_where(t.nation, ("n_name", "~", "N_1")), ["n_nationkey", "n_name"]))
_plain("filter_like_int", f"{_PART} p_size = 7",
       lambda t: R.project(_where(t.part, ("p_size", "LIKE", 7)), ["p_partkey", "p_name", "p_size"]))
_plain("filter_conj", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 3 AND l_returnflag = 'R' AND l_partkey < 500",
       lambda t: R.project(_where(t.lineitem, ("l_linenumber", ">=", 3), ("l_returnflag", "=", "R"), ("l_partkey", "<", 500)),
                           ["l_orderkey", "l_linenumber"]))
_plain("filter_string_range", "SELECT p_partkey, p_type FROM part WHERE p_type > 'LARGE' AND p_type <= 'SMALL'",
       lambda t: R.project(_where(t.part, ("p_type", ">", "LARGE"), ("p_type", "<=", "SMALL")), ["p_partkey", "p_type"]))
_plain("filter_const_left", 'SELECT p_partkey AS "part.p_partkey" FROM part WHERE 40 < p_size',
       lambda t: t.engine().sql("SELECT p_partkey FROM part WHERE 40 < p_size"))

# projection
_plain("project_reorder", "SELECT n_name, n_nationkey, n_name AS n_name_again FROM nation",
       lambda t: R.project(t.nation, ["n_name", "n_nationkey", "n_name"], ["n_name", "n_nationkey", "n_name_again"]))
_plain("project_star_join",
       "SELECT n_nationkey AS \"n.n_nationkey\", n_name AS \"n.n_name\", n_regionkey AS \"n.n_regionkey\", "
       "r_regionkey AS \"r.r_regionkey\", r_name AS \"r.r_name\" FROM nation JOIN region ON n_regionkey = r_regionkey",
       lambda t: t.engine().sql("SELECT * FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey"))

# joins
_plain("join_equi", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
       lambda t: R.project(R.join(t.customer, t.nation, _on("c_nationkey", "=", "n_nationkey")), ["c_custkey", "n_name"]))
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("neq", "<>")):
    _plain(
        f"join_theta_{_name}", f"SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_nationkey {_op} b.n_nationkey",
        lambda t, o=_op: R.project(
            R.join(R.scan(t.nation, "a"), R.scan(t.nation, "b"), _on("a.n_nationkey", o, "b.n_nationkey")),
            ["a.n_nationkey", "b.n_nationkey"], ["a_key", "b_key"],
        ),
    )
_plain("join_like", "SELECT a.p_type AS a_type, count(*) AS n FROM part a JOIN (SELECT DISTINCT p_type FROM part) b ON contains(a.p_type, b.p_type) GROUP BY 1",
       lambda t: R.join(R.scan(t.part, "a"), R.scan(t.part.select("p_type").distinct(), "b"), _on("a.p_type", "LIKE", "b.p_type"))
       .groupBy(F.col("`a.p_type`").alias("a_type")).agg(F.count(F.lit(1)).alias("n")))
_plain("join_self_alias", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
       lambda t: R.project(R.join(R.scan(t.nation, "a"), R.scan(t.nation, "b"), _on("a.n_regionkey", "=", "b.n_regionkey")),
                           ["a.n_name", "b.n_name"], ["a_name", "b_name"]))
_plain("join_three_way",
       "SELECT r_name, n_name, c_custkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey",
       lambda t: R.project(R.cross_checked_join([t.region, t.nation, t.customer],
                           [_on("r_regionkey", "=", "n_regionkey"), _on("c_nationkey", "=", "n_nationkey")]), ["r_name", "n_name", "c_custkey"]))
_FOUR = (
    "FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey"
)
_plain("join_four_way", f"SELECT r_name, n_name, o_orderkey {_FOUR}",
       lambda t: R.project(R.cross_checked_join([t.region, t.nation, t.customer, t.orders],
                           [_on("r_regionkey", "=", "n_regionkey"), _on("n_nationkey", "=", "c_nationkey"), _on("c_custkey", "=", "o_custkey")]),
                           ["r_name", "n_name", "o_orderkey"]))
for _name, _strategy in (("merge", "sort_merge"), ("hash", "hash"), ("broadcast", "broadcast_hash"), ("auto", "auto")):
    # the broadcast form sends nation, whose 25 rows are the bound
    _plain(
        f"join_{_name}_hint",
        "SELECT n_name, count(o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        lambda t, s=_strategy: R.join(
            R.join(t.orders, t.customer, _on("o_custkey", "=", "c_custkey"), strategy="auto" if s == "broadcast_hash" else s),
            t.nation, _on("c_nationkey", "=", "n_nationkey"), strategy=s,
        ).groupBy("n_name").agg(F.count("o_orderkey").alias("n")),
    )
_plain("join_two_predicates", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal GROUP BY 1",
       lambda t: R.join(t.supplier, t.customer, _on("s_nationkey", "=", "c_nationkey"), _on("s_acctbal", "<", "c_acctbal"))
       .groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n")))
_plain("join_subquery_scalar", 'SELECT p_partkey AS "part.p_partkey" FROM part JOIN (SELECT max(p_size) m FROM part) s ON p_size = s.m',
       lambda t: t.engine().sql("SELECT p_partkey FROM part WHERE p_size = (SELECT MAX(p.p_size) FROM part p)"))
_plain("join_subquery_multi", "SELECT n_name, count(*) AS n FROM nation JOIN (SELECT c_nationkey k FROM customer) s ON n_nationkey = s.k GROUP BY 1",
       lambda t: R.subquery_join(t.nation, "n_nationkey", Op.EQ, t.customer.select("c_nationkey"))
       .groupBy("n_name").agg(F.count(F.lit(1)).alias("n")))

# aggregates
_AGG_SQL = {
    "min": "min({0})", "max": "max({0})", "sum": "CAST(sum({0}) AS BIGINT)", "avg": "CAST(trunc(avg({0})) AS INTEGER)", "count": "count({0})",
}
for _op, _sql in _AGG_SQL.items():
    _plain(f"agg_{_op}", f'SELECT {_sql.format("p_size")} AS "{_op}(p_size)" FROM part', lambda t, o=_op: R.aggregate(t.part, o, "p_size"))
    _plain(f"agg_{_op}_grouped_string", f'SELECT p_brand, {_sql.format("p_size")} AS "{_op}(p_size)" FROM part GROUP BY p_brand',
           lambda t, o=_op: R.aggregate(t.part, o, "p_size", "p_brand"))
    _plain(f"agg_{_op}_grouped_int", f'SELECT l_linenumber, {_sql.format("l_suppkey")} AS "{_op}(l_suppkey)" FROM lineitem GROUP BY l_linenumber',
           lambda t, o=_op: R.aggregate(t.lineitem, o, "l_suppkey", "l_linenumber"))
_plain("agg_count_string", 'SELECT o_orderstatus, count(o_orderpriority) AS "count(o_orderpriority)" FROM orders GROUP BY o_orderstatus',
       lambda t: R.aggregate(t.orders, "count", "o_orderpriority", "o_orderstatus"))
_plain("agg_count_star", 'SELECT count(*) AS "count(*)" FROM orders', lambda t: R.aggregate(t.orders, "count", "*"))
_plain("agg_empty_global", 'SELECT count(p_size) AS "count(p_size)" FROM part WHERE p_size < 0',
       lambda t: R.aggregate(_where(t.part, ("p_size", "<", 0)), "count", "p_size"))
_plain("agg_after_join", 'SELECT n_name AS "n.n_name", count(o_orderkey) AS "count(o.o_orderkey)" FROM nation, customer, orders '
       "WHERE n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY n_name",
       lambda t: t.engine().sql("SELECT n.n_name, COUNT(o.o_orderkey) FROM nation n, customer c, orders o "
                                "WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey GROUP BY n.n_name"))  # fmt: skip
_plain("agg_partial_final_avg", 'SELECT p_brand, CAST(trunc(avg(p_size)) AS INTEGER) AS "avg(p_size)" FROM part GROUP BY p_brand',
       lambda t: R.partial_average(t.part, "p_size", "p_brand", F.pmod("p_partkey", F.lit(8))))
_plain("agg_running", 'SELECT n_nationkey, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS "sum(n_nationkey)" FROM nation',
       lambda t: running_by_row(t.nation, "sum", "n_nationkey", "n_regionkey", "n_nationkey").select("n_nationkey", "sum(n_nationkey)"))

# order
_plain("order_asc", "SELECT c_custkey, c_name FROM customer ORDER BY c_name", lambda t: R.order_by(R.project(t.customer, ["c_custkey", "c_name"]), "c_name"))
_plain("order_desc", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC",
       lambda t: R.order_by(R.project(t.part, ["p_partkey", "p_size"]), "p_size", False))
_plain("order_unselected", 'SELECT n_name AS "nation.n_name" FROM nation ORDER BY n_regionkey',
       lambda t: t.engine().sql("SELECT n_name FROM nation ORDER BY n_regionkey DESC"))
_plain("order_group", 'SELECT p_brand AS "part.p_brand", max(p_size) AS "max(part.p_size)" FROM part GROUP BY p_brand ORDER BY p_brand DESC',
       lambda t: t.engine().sql("SELECT p_brand, MAX(p_size) FROM part GROUP BY p_brand ORDER BY p_brand DESC"))

_FLAGSHIP_SQL = (
    'SELECT n_name AS "n.n_name", count(l_orderkey) AS "count(l.l_orderkey)" FROM lineitem, orders, customer, nation '
    "WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND l_suppkey < 10 GROUP BY n_name"
)


@_query("flagship_emp_dept_shape", _FLAGSHIP_SQL)
def _flagship(t: Tables) -> DataFrame:
    return t.engine().sql(
        "SELECT n.n_name, COUNT(l.l_orderkey) FROM lineitem l, orders o, customer c, nation n WHERE l.l_orderkey = o.o_orderkey "
        "AND o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND l.l_suppkey < 10 GROUP BY n.n_name ORDER BY n.n_name"
    )


@_query("selinger_ordered_join", f'SELECT r_name AS "r.r_name", n_name AS "n.n_name", o_orderkey AS "o.o_orderkey" {_FOUR}')
def _selinger(t: Tables) -> DataFrame:
    """The order comes from statistics of the tables."""
    e = t.engine()
    e.analyze("region", "nation", "customer", "orders")
    return e.sql(
        "SELECT r.r_name, n.n_name, o.o_orderkey FROM region r, nation n, customer c, orders o "
        "WHERE c.c_custkey = o.o_custkey AND n.n_nationkey = c.c_nationkey AND r.r_regionkey = n.n_regionkey"
    )


# statistics
@_query("histogram_int", "SELECT CAST(least(floor((p_size - 1) / 5), 9) AS BIGINT) AS bucket, count(*) AS n FROM part GROUP BY 1")
def _histogram(t: Tables) -> DataFrame:
    return histogram(t.part, "p_size", 10, 1, 50)


@_query(
    "histogram_string",
    "SELECT CAST(floor((ascii(substr(n_name, 1, 1)) * 16777216 + ascii(substr(n_name, 2, 1)) * 65536 + ascii(substr(n_name, 3, 1)) * 256 "
    "+ ascii(substr(n_name, 4, 1))) / 20543184) AS BIGINT) AS bucket, count(*) AS n FROM nation GROUP BY 1",
)
def _histogram_string(t: Tables) -> DataFrame:
    from .stats import string_key_column

    return histogram(t.nation.select(string_key_column("n_name").alias("k")), "k", 100, 0, 0x7A7A7A7A)


@_query(
    "table_stats",
    "SELECT c AS column_name, CAST(n AS BIGINT) AS n_rows, CAST(lo AS BIGINT) AS low, CAST(hi AS BIGINT) AS high FROM ("
    "SELECT 'p_partkey' c, count(*) n, min(p_partkey) lo, max(p_partkey) hi FROM part UNION ALL "
    "SELECT 'p_size', count(*), min(p_size), max(p_size) FROM part)",
)
def _table_stats(t: Tables) -> DataFrame:
    s = TableStats(t.part)
    rows = [(c, s.n_rows, lo, hi) for c, (lo, hi) in s.low_high.items()]
    return t.spark.createDataFrame(rows, "column_name string, n_rows long, low long, high long")


@_query("join_order_estimates", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'nation', 'customer'), (2, 'customer', 'orders')) v(step, outer_alias, inner_alias)")
def _order(t: Tables) -> DataFrame:
    found = order_joins(
        [JoinNode("orders", "o_custkey", Op.EQ, "customer", "c_custkey"), JoinNode("customer", "c_nationkey", Op.EQ, "nation", "n_nationkey")],
        {"orders": Input(1e6, 150_000), "customer": Input(1e4, 1500, "c_custkey"), "nation": Input(1e3, 25, "n_nationkey")},
    )
    return t.spark.createDataFrame([(k, j.left, j.right) for k, j in enumerate(found, 1)], "step long, outer_alias string, inner_alias string")


def _orders_stats(t: Tables) -> TableStats:
    return TableStats(t.orders.select("o_orderkey", "o_custkey"))


@_query("estimate_scan_cost", "SELECT CAST(ceil(count(*) * 16 / 4096.0) * 1000 AS BIGINT) AS cost, CAST(floor(count(*) * 0.3) AS BIGINT) AS rows_at_30_percent FROM orders")
def _scan_cost(t: Tables) -> DataFrame:
    s = _orders_stats(t)
    return t.spark.createDataFrame([(int(s.scan_cost()), s.cardinality(0.3))], "cost long, rows_at_30_percent long")


_SEL = [("=", 25), ("<>", 25), ("<", 25), ("<=", 25), (">", 25), (">=", 25), ("<", 0), (">", 0)]


@_query(
    "estimate_selectivity",
    " UNION ALL ".join(f"SELECT '{o} {v}' AS predicate, round(avg(CASE WHEN p_size {o} {v} THEN 1.0 ELSE 0.0 END), 6) AS selectivity FROM part" for o, v in _SEL),
)
def _selectivity(t: Tables) -> DataFrame:
    """With 100 buckets for sizes of 1 to 50 each value has a bucket of its own, so estimates are exact."""
    s = TableStats(t.part.select("p_size"))
    return t.spark.createDataFrame([(f"{o} {v}", round(s.selectivity("p_size", Op.parse(o), v), 6)) for o, v in _SEL], "predicate string, selectivity double")


@_query("estimate_average_selectivity", "SELECT 1.0 / count(DISTINCT n_regionkey) AS selectivity FROM nation")
def _average(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(TableStats(t.nation).average_selectivity("n_regionkey"),)], "selectivity double")


_CARDS = {
    "equality on a key": ("o", JoinNode("o", "o_custkey", Op.EQ, "c", "c_custkey")), "equality without key": ("greatest(o, c)", JoinNode("o", "x", Op.EQ, "c", "y")),
    "range": ("CAST(floor(0.3 * o * c) AS BIGINT)", JoinNode("o", "x", Op.LT, "c", "y")), "inequality": ("o * c - greatest(o, c)", JoinNode("o", "x", Op.NE, "c", "y")),
}


@_query(
    "estimate_join_cardinality",
    " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({sql} AS BIGINT) AS n_rows FROM (SELECT count(*) o FROM orders) a, (SELECT count(*) c FROM customer) b" for k, (sql, _) in _CARDS.items()),
)
def _join_cards(t: Tables) -> DataFrame:
    n = [TableStats(d).n_rows for d in (t.orders.select("o_custkey"), t.customer.select("c_custkey"))]
    return t.spark.createDataFrame([(k, join_rows(j, *n, False, j.right_column == "c_custkey")) for k, (_, j) in _CARDS.items()], "kind string, n_rows long")


_PAIR_COST = "ceil({0} * {1} / 4096.0) * 1000"


@_query(
    "estimate_join_cost",
    "SELECT CAST(oc + o * cc + o * c AS BIGINT) AS orders_outside, CAST(cc + c * oc + o * c AS BIGINT) AS customer_outside, "
    "CASE WHEN oc + o * cc <= cc + c * oc THEN 'o' ELSE 'c' END AS outer_alias "
    f"FROM (SELECT count(*) o, {_PAIR_COST.format('count(*)', 16)} oc FROM orders) a, (SELECT count(*) c, {_PAIR_COST.format('count(*)', 8)} cc FROM customer) b",
)
def _join_costs(t: Tables) -> DataFrame:
    o, c = _orders_stats(t), TableStats(t.customer.select("c_custkey"))
    node = JoinNode("o", "o_custkey", Op.EQ, "c", "c_custkey")
    costs = join_cost(node, o.n_rows, c.n_rows, o.scan_cost(), c.scan_cost()), join_cost(node.swapped(), c.n_rows, o.n_rows, c.scan_cost(), o.scan_cost())
    first = order_joins([node], {"o": Input(o.scan_cost(), o.n_rows), "c": Input(c.scan_cost(), c.n_rows, "c_custkey")})[0].left
    return t.spark.createDataFrame([(*map(int, costs), first)], "orders_outside long, customer_outside long, outer_alias string")


# key-clustered tables
def _clustered(t: Tables) -> str:
    path = t.scratch()
    write_sorted(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), path, "o_orderkey")
    return path


for _name, _op, _v, _sql in (
    ("index_range_scan", ">=", 9000, "o_orderkey >= 9000"), ("index_eq_scan", "=", 77, "o_orderkey = 77"), ("index_lt_scan", "<", 500, "o_orderkey < 500"),
    ("index_neq_scan", "<>", 500, "o_orderkey <> 500"), ("index_gt_scan", ">", 9000, "o_orderkey > 9000"), ("index_le_scan", "<=", 500, "o_orderkey <= 500"),
):
    _plain(_name, f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE {_sql}",
           lambda t, o=_op, v=_v: index_scan(t.spark, _clustered(t), "o_orderkey", Op.parse(o), v))
_plain("index_full_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey",
       lambda t: index_scan(t.spark, _clustered(t), "o_orderkey", ordered=True))


@_query("index_like_scan", "SELECT p_name, p_partkey FROM part WHERE contains(p_name, 'anvil')")
def _index_like(t: Tables) -> DataFrame:
    path = t.scratch()
    write_sorted(t.part.select("p_name", "p_partkey"), path, "p_name")
    return index_scan(t.spark, path, "p_name", Op.LIKE, "anvil")


# heap files
@_query("convert_text", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation")
def _convert(t: Tables) -> DataFrame:
    text, heap = t.scratch(), t.scratch()
    t.nation.select(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey")).write.text(text)
    schema = T._parse_datatype_string("k int, name string, r int")
    convert(t.spark, text, heap, schema, "|")
    return read_heap(t.spark, heap, schema)


@_query("heap_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _heap(t: Tables) -> DataFrame:
    path = t.scratch()
    rows = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    write_heap(rows, path)
    return read_heap(t.spark, path, rows.schema)


# snapshot tables
def _database(t: Tables) -> Database:
    db = Database(t.spark, t.scratch())
    db.create("nations", T.StructType([T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("r", T.IntegerType())]), "k")
    db.insert("nations", t.nation)
    return db


@_query("insert_select_count", "SELECT CAST(count(*) AS INTEGER) AS count FROM nation WHERE n_regionkey = 1")
def _insert_count(t: Tables) -> DataFrame:
    e = Engine(t.spark, _database(t))
    return e.sql("INSERT INTO nations SELECT * FROM nations WHERE r = 1")


@_query("insert_then_scan", "SELECT k, name, r FROM (SELECT n_nationkey k, n_name AS name, n_regionkey r FROM nation UNION ALL SELECT 99, 'new', 0)")
def _insert_scan(t: Tables) -> DataFrame:
    e = Engine(t.spark, _database(t))
    e.sql("INSERT INTO nations VALUES (99, 'new', 0)")
    return e.database.table("nations")


@_query("delete_count", "SELECT CAST(count(*) AS INTEGER) AS count FROM nation WHERE n_regionkey > 2")
def _delete_count(t: Tables) -> DataFrame:
    return Engine(t.spark, _database(t)).sql("DELETE FROM nations WHERE r > 2")


@_query("delete_where_remaining", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation WHERE NOT (n_regionkey > 2)")
def _delete_rest(t: Tables) -> DataFrame:
    e = Engine(t.spark, _database(t))
    e.sql("DELETE FROM nations WHERE r > 2")
    return e.database.table("nations")


@_query("txn_rollback_unchanged", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation")
def _rollback(t: Tables) -> DataFrame:
    e = Engine(t.spark, _database(t))
    e.script("SET TRANSACTION READ WRITE; DELETE FROM nations; INSERT INTO nations VALUES (1, 'x', 1); ROLLBACK;")
    return e.database.table("nations")


@_query("txn_commit_visible", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 100, 'in', 7")
def _commit(t: Tables) -> DataFrame:
    e = Engine(t.spark, _database(t))
    e.script("SET TRANSACTION READ WRITE; DELETE FROM nations WHERE r = 0; INSERT INTO nations VALUES (100, 'in', 7); COMMIT;")
    return e.database.table("nations")


@_query("txn_isolation", "SELECT 'seen' AS what, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'latest', count(*) + 1 FROM nation")
def _isolation(t: Tables) -> DataFrame:
    """An open transaction keeps seeing what was committed when it began."""
    db = _database(t)
    early = db.begin()
    Engine(t.spark, db).sql("INSERT INTO nations VALUES (100, 'in', 7)")
    count = lambda what, d: d.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return count("seen", db.table("nations", early)).unionByName(count("latest", db.table("nations")))


@_query("txn_conflict_aborts", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation UNION ALL SELECT 100, 'first', 7")
def _conflict(t: Tables) -> DataFrame:
    """Of two transactions that change a table, the one that commits second is aborted and leaves nothing."""
    db = _database(t)
    engines = [Engine(t.spark, db) for _ in range(2)]
    for k, e in enumerate(engines):
        e.sql("SET TRANSACTION READ WRITE")
        e.sql(f"INSERT INTO nations VALUES ({100 + k}, '{('first', 'second')[k]}', 7)")
    engines[0].sql("COMMIT")
    try:
        engines[1].sql("COMMIT")
    except TransactionAborted:
        return db.table("nations")
    raise AssertionError("the second commit went through")


@_query("txn_recovery", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation UNION ALL SELECT 100, 'in', 7")
def _recovery(t: Tables) -> DataFrame:
    """A new session over the folder sees what was committed and nothing of a transaction that was lost."""
    db = _database(t)
    Engine(t.spark, db).sql("INSERT INTO nations VALUES (100, 'in', 7)")
    lost = Engine(t.spark, db)
    lost.sql("SET TRANSACTION READ WRITE")
    lost.sql("INSERT INTO nations VALUES (101, 'lost', 7)")
    return Database(t.spark, db.root).table("nations")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return _flagship(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        return run

    return {name: bound(f) for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
