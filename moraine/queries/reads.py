"""Reading: predicates, pruning, joins, aggregates, windows, sets, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import predicates as P
from ..plans.joins import asof_join, positional_join
from .base import Query, sources


def _same(name: str, tables: tuple[str, ...], text: str, oracle: str | None = None, args: list | None = None, layout=None) -> Query:
    """A text that DuckDB takes as it is, but for the names of tables."""
    return Query(name, oracle or text.replace("db.", ""), tables, text, args, None, layout)


def _money(x: str) -> str:
    """A sum that doesn't depend on the order of rows."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


O, L, C, E = ("orders",), ("lineitem",), ("customer",), ("events",)
COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def _where(name: str, condition: str, oracle: str | None = None, args: list | None = None) -> Query:
    return Query(name, f"SELECT {COLS} FROM orders WHERE {oracle or condition}", O, f"SELECT {COLS} FROM db.orders WHERE {condition}", args)


def _read(name: str, where, oracle: str) -> Query:
    """Through the programmatic predicates."""
    return Query(name, f"SELECT {COLS} FROM orders WHERE {oracle}", O, make=lambda e, d: e.read("db.orders", where, columns=COLS.split(", ")))


def _insert_select_filter(e, d):
    return e.sql(f"SELECT l_returnflag, l_linestatus, {_money('l_quantity')} AS sum_qty, {_money('l_extendedprice')} AS sum_price, COUNT(*) AS n FROM db.lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")


def _struct(e, d):
    sources(e, d, "orders")
    e.create_table("db.nested", "id BIGINT, s STRUCT<status STRING, t STRUCT<price DOUBLE, cust BIGINT>>")
    e.insert_into("db.nested").sql("SELECT o_orderkey AS id, named_struct('status', o_orderstatus, 't', named_struct('price', o_totalprice, 'cust', o_custkey)) AS s FROM orders").execute()
    return e.sql("SELECT id, s.t.cust AS cust FROM db.nested WHERE s.status = 'F' AND s.t.price > 100000")


def _floats(e, d):
    e.create_table("db.f", "id INT, f FLOAT, d DOUBLE", ["d"])
    e.insert_into("db.f").sql("SELECT id, CAST(v AS FLOAT) AS f, CAST(v AS DOUBLE) AS d FROM VALUES (1, '1.5'), (2, '-1.5'), (3, '0'), (4, 'Infinity'), (5, '-Infinity'), (6, 'NaN'), (7, NULL) AS x(id, v)").execute()
    cases = ["d > 1", "d >= 'nan'", "d < 'inf'", "d = 'nan'", "d != 'nan'", "f <= '-inf'", "d IN (0, 'nan')", "NOT d > 0", "f = 'infinity'"]
    out = None
    for k, c in enumerate(cases):
        one = e.read("db.f", c).select(F.lit(k).alias("k"), "id")
        out = one if out is None else out.unionByName(one)
    return out


_FLOATS = "WITH f AS (SELECT * FROM (VALUES (1, 1.5::DOUBLE), (2, -1.5), (3, 0), (4, 'inf'::DOUBLE), (5, '-inf'::DOUBLE), (6, 'nan'::DOUBLE), (7, NULL)) x(id, d)) " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, id FROM f WHERE {c}" for k, c in enumerate(["d > 1", "d >= 'nan'", "d < 'inf'", "d = 'nan'", "d != 'nan'", "d <= '-inf'", "d IN (0, 'nan')", "NOT d > 0", "d = 'inf'"]))


def _part(name: str, partitioning: list, condition: str, tables: tuple[str, ...] = O, oracle: str | None = None, cols: str = "o_orderkey, o_custkey, o_orderstatus") -> Query:
    t = tables[0]
    return Query(name, f"SELECT {cols} FROM {t} WHERE {oracle or condition}", tables, f"SELECT {cols} FROM db.{t} WHERE {condition}", layout=(partitioning, []))


def _counts(e, d):
    rows = [(v["o_orderdate_year"] + 1970, n) for _, v, n in e.partition_counts("db.orders")]
    return e.spark.createDataFrame(rows, "y int, n long").groupBy("y").agg(F.sum("n").alias("n"))


def _file_columns(e, d):
    return e.read("db.orders", file_columns=True).groupBy("filename").agg((F.max("file_row_number") + 1).alias("rows"), F.count("*").alias("n")).agg(F.sum("n").alias("n"), (F.sum("rows") == F.sum("n")).alias("dense"))


def _parquet_source(e, d):
    return e.read_parquet([f"{d}/nation.parquet", f"{d}/region.parquet"], union_by_name=True).select("n_nationkey", "n_name", "r_regionkey", "r_name")


def _filter_table(e, d):
    e.spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '1995-01-01 00:00:00', 'F'), (TIMESTAMP_NTZ '1996-06-01 00:00:00', 'O') AS x(day, status)").createOrReplaceTempView("wanted")
    return e.sql("SELECT o.o_orderkey, w.status FROM db.orders o INNER JOIN wanted w ON o.o_orderdate >= w.day AND o.o_orderstatus = w.status")


def _union_by_name(e, d):
    a, b = e.sql("SELECT o_orderkey AS k, o_orderstatus AS s FROM db.orders"), e.sql("SELECT o_orderpriority AS p, o_orderkey AS k FROM db.orders")
    return a.unionByName(b, allowMissingColumns=True)


def _asof(e, d):
    """For each click the user's last purchase at or before it."""
    clicks = e.sql("SELECT event_id, user_id, ts FROM db.events WHERE event_type = 'click'")
    bought = e.sql("SELECT user_id, ts AS at, value AS last_v FROM db.events WHERE event_type = 'purchase'")
    return asof_join(clicks, bought, ["user_id"], "ts", "at").select("event_id", "last_v")


def _approx_distinct(e, d):
    """The sketch has groups of its own: in one aggregation with the exact count each of that one's groups, a row a customer, would carry a sketch."""
    near = e.sql("SELECT o_orderstatus, APPROX_COUNT_DISTINCT(o_custkey, 0.02) AS sketch FROM db.orders GROUP BY o_orderstatus")
    exact = e.sql("SELECT o_orderstatus AS status, COUNT(DISTINCT o_custkey) AS customers FROM db.orders GROUP BY o_orderstatus")
    both = near.join(exact, F.col("o_orderstatus").eqNullSafe(F.col("status")))
    return both.select("o_orderstatus", (F.abs(F.col("sketch") - F.col("customers")) <= 0.1 * F.col("customers")).alias("near"), "customers")


def _positional(e, d):
    a, b = e.sql("SELECT c_custkey FROM db.customer"), e.sql("SELECT o_orderkey FROM db.orders")
    return positional_join(a, b, ["c_custkey"], ["o_orderkey"])


def _templates(e, d):
    e.templates.load("-- name: orders.by_status\nSELECT o_orderkey, o_custkey FROM db.orders WHERE o_orderstatus = :status [[AND o_totalprice > :price]]\n")
    return e.statement("orders.by_status", {"status": "F", "price": None})


def _import(e, d):
    from ..sources.importer import to_view

    sources(e, d, "nation")
    rows = [r.asDict() for r in e.spark.table("nation").collect()]
    to_view(e.spark, rows, e.spark.table("nation").schema, "imported")
    return e.sql("SELECT n_regionkey, COUNT(*) AS n FROM imported GROUP BY n_regionkey")


def _guard(e, d):
    from ..errors import ValidationError

    e.allow_full_scan = False
    try:
        e.sql("SELECT * FROM db.orders")
        refused = False
    except ValidationError:
        refused = True
    return e.sql("SELECT COUNT(*) AS n FROM db.orders WHERE o_orderkey >= 0").withColumn("refused", F.lit(refused))


def _markers(e, d):
    return e.sql("--LAKE_PARSE_BEGIN--SELECT o_orderstatus, COUNT(*) AS n FROM db.orders WHERE o_custkey > 10--LAKE_PARSE_END-- GROUP BY o_orderstatus")


READS = [
    Query("insert_select_filter", f"SELECT l_returnflag, l_linestatus, {_money('l_quantity')} AS sum_qty, {_money('l_extendedprice')} AS sum_price, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", L, make=_insert_select_filter),
    _where("pred_compare", "o_totalprice > 150000 AND o_custkey <= 700 AND 100 < o_orderkey AND o_orderstatus != 'P'"),
    _where("pred_or_not", "NOT (o_totalprice > 50000 OR o_orderstatus = 'F') OR o_orderkey = 7"),
    _where("pred_between", "o_totalprice BETWEEN 1000 AND 90000 AND o_orderkey NOT BETWEEN 100 AND 9000"),
    _where("pred_in_null", "o_orderstatus IN ('F', NULL)"),
    _where("pred_not_in_null", "o_orderstatus NOT IN ('F', NULL)"),
    _where("pred_is_null", "o_orderstatus IS NOT NULL AND o_custkey IS NOT NULL"),
    _where("pred_distinct_from", "o_orderstatus IS DISTINCT FROM 'F' AND o_orderpriority IS NOT DISTINCT FROM '1-URGENT'"),
    _where("pred_not_pushdown", "NOT (o_orderkey < 1000 AND NOT (o_custkey > 100 OR o_orderstatus = 'O'))"),
    _where("pred_params", "o_orderstatus = ? AND o_totalprice >= ? AND o_orderdate < ?", "o_orderstatus = 'O' AND o_totalprice >= 2000.5 AND o_orderdate < TIMESTAMP '1996-05-01'", ["O", 2000.5, "1996-05-01 00:00:00"]),
    _where("pred_cast_literals", "o_orderkey > CAST(100 AS BIGINT) AND o_orderdate >= DATE '1996-01-01' AND o_totalprice > 10::DOUBLE"),
    _where("pred_like", "o_orderpriority LIKE '1%' AND o_orderkey > 10"),
    _read("pred_starts_with", P.and_(P.starts_with("o_orderpriority", "2-"), P.not_starts_with("o_orderstatus", "F")), "starts_with(o_orderpriority, '2-') AND NOT starts_with(o_orderstatus, 'F')"),
    _read("pred_api", P.or_(P.and_(P.greater_than("o_totalprice", 200000), P.not_in("o_orderstatus", "F", "P")), P.between("o_orderkey", 5, 50), P.always_false()), "(o_totalprice > 200000 AND o_orderstatus NOT IN ('F', 'P')) OR o_orderkey BETWEEN 5 AND 50"),
    Query("pred_bool", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 100000 AND NOT o_orderstatus = 'F'", O, make=lambda e, d: (e.create_table("db.b", "id BIGINT, big BOOLEAN, f BOOLEAN", ["big"]), e.insert_into("db.b").sql("SELECT o_orderkey AS id, o_totalprice > 100000 AS big, o_orderstatus = 'F' AS f FROM orders").execute(), e.sql("SELECT id FROM db.b WHERE big AND NOT f"))[-1]),
    Query("pred_struct_field", "SELECT o_orderkey AS id, o_custkey AS cust FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000", make=_struct),
    Query("pred_float_special", _FLOATS, make=_floats),
    _part("part_identity", ["o_orderstatus"], "o_orderstatus = 'P'"),
    _part("part_year", ["year(o_orderdate)"], "o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'"),
    _part("part_month", ["month(o_orderdate)"], "o_orderdate >= TIMESTAMP '1996-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-05-15 00:00:00'"),
    _part("part_day", ["day(ts)"], "ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-03 12:00:00'", E, cols="event_id, user_id, event_type"),
    _part("part_hour", ["hour(ts)"], "ts < TIMESTAMP '2024-01-01 12:00:00'", E, cols="event_id, user_id, event_type"),
    _part("part_truncate", ["truncate(1000, o_custkey)", "truncate(1, o_orderpriority)"], "o_custkey BETWEEN 990 AND 1005 OR o_orderpriority = '5-LOW'"),
    _part("part_bucket", ["bucket(8, o_custkey)", "bucket(4, o_orderpriority)"], "o_custkey IN (1, 2, 77, 500) OR o_orderpriority = '3-MEDIUM' AND o_custkey = 10"),
    _part("part_mixed", ["month(o_orderdate)", "bucket(2, o_orderkey)"], "o_orderkey = 1001 OR o_orderdate < TIMESTAMP '1992-02-01 00:00:00'"),
    Query("part_counts", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, COUNT(*) AS n FROM orders GROUP BY 1", O, make=_counts),
    Query("scan_guard", "SELECT COUNT(*) AS n, true AS refused FROM orders", O, make=_guard),
    Query("scan_file_columns", "SELECT COUNT(*) AS n, true AS dense FROM orders", O, make=_file_columns),
    Query("scan_parquet_source", "SELECT n_nationkey, n_name, CAST(NULL AS INTEGER) AS r_regionkey, CAST(NULL AS VARCHAR) AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_regionkey, r_name FROM region", make=_parquet_source),
    Query("sql_markers", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey > 10 GROUP BY o_orderstatus", O, make=_markers),
    _same("join_inner", O + C, f"SELECT c.c_mktsegment, COUNT(*) AS n, {_money('o.o_totalprice')} AS total FROM db.orders o JOIN db.customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderdate < TIMESTAMP '1995-03-15 00:00:00' GROUP BY c.c_mktsegment"),
    _same("join_left", C + O, "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM db.customer c LEFT JOIN db.orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey"),
    _same("join_right", C + O, "SELECT o.o_orderkey, c.c_name FROM db.customer c RIGHT JOIN db.orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 5000"),
    _same("join_full", ("supplier", "customer"), "SELECT s.s_suppkey, c.c_custkey FROM db.supplier s FULL JOIN db.customer c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 0"),
    _same("join_semi", C + O, "SELECT c_custkey, c_name FROM db.customer WHERE c_custkey IN (SELECT o_custkey FROM db.orders WHERE o_totalprice > 250000)"),
    _same("join_anti", C + O, "SELECT c_custkey, c_name FROM db.customer c WHERE NOT EXISTS (SELECT 1 FROM db.orders o WHERE o.o_custkey = c.c_custkey)"),
    _same("join_range", ("nation", "part"), "SELECT n.n_nationkey, COUNT(*) AS parts FROM db.nation n JOIN db.part p ON p.p_size BETWEEN n.n_nationkey AND n.n_nationkey + 2 GROUP BY n.n_nationkey"),
    _same("join_using_cross", ("nation", "region"), "SELECT a.n_name, r.r_name, (a.n_regionkey = r.r_regionkey) AS home FROM db.nation a CROSS JOIN db.region r"),
    Query("join_asof", "SELECT a.event_id, (SELECT arg_max(b.value, b.ts) FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts <= a.ts) AS last_v FROM events a WHERE a.event_type = 'click'", E, make=_asof),
    Query("join_positional", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) FULL JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) USING (n)", C + O, make=_positional),
    Query("join_filter_table", "SELECT o.o_orderkey, w.status FROM orders o JOIN (VALUES (TIMESTAMP '1995-01-01', 'F'), (TIMESTAMP '1996-06-01', 'O')) w(day, status) ON o.o_orderdate >= w.day AND o.o_orderstatus = w.status", O, make=_filter_table),
    _same("join_lake_subqueries", O + L, f"SELECT o.o_orderpriority, {_money('l.l_quantity')} AS qty FROM (SELECT * FROM db.orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00') o JOIN (SELECT * FROM db.lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00') l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderpriority"),
    _same("agg_having", O, "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top FROM db.orders GROUP BY o_custkey HAVING COUNT(*) > 10"),
    _same("agg_distinct", O, "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS big FROM db.orders GROUP BY o_orderstatus"),
    _same("agg_select_distinct", O, "SELECT DISTINCT o_orderstatus, o_orderpriority FROM db.orders"),
    _same("agg_rollup", O, "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM db.orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    _same("agg_cube", O, "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM db.orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    _same("agg_grouping_sets", O, "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MIN(o_orderkey) AS k FROM db.orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    _same("agg_group_by_all", O, "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM db.orders GROUP BY ALL"),
    _same("agg_min_max_by", O, "SELECT o_orderstatus, MAX_BY(o_orderkey, o_totalprice) AS best, MIN_BY(o_orderkey, o_totalprice) AS least FROM db.orders GROUP BY o_orderstatus"),
    # a sketch: within a tenth of the exact count, two relative standard deviations
    Query("agg_approx_distinct", "SELECT o_orderstatus, true AS near, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus", O, make=_approx_distinct),
    Query("agg_percentile", "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS mid, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS all_p FROM orders GROUP BY o_orderstatus", O, "SELECT o_orderstatus, PERCENTILE(o_totalprice, 0.5) AS mid, ARRAY_JOIN(SORT_ARRAY(COLLECT_SET(o_orderpriority)), ',') AS all_p FROM db.orders GROUP BY o_orderstatus"),
    _same("win_row_number", O, "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM db.orders) x WHERE rn <= 2"),
    _same("win_rank", O, "SELECT o_orderkey, CAST(RANK() OVER w AS INTEGER) AS r, CAST(DENSE_RANK() OVER w AS INTEGER) AS dr, CAST(NTILE(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS q FROM db.orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_custkey)"),
    _same("win_lag_lead", O, "SELECT o_orderkey, LAG(o_orderkey) OVER w AS before, LEAD(o_orderkey, 2) OVER w AS later, FIRST_VALUE(o_orderkey) OVER w AS first_k FROM db.orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    _same("win_running_sum", O, f"SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS s FROM db.orders"),
    Query("win_list", "SELECT DISTINCT o_custkey, array_to_string(list_sort(list(o_orderstatus) OVER (PARTITION BY o_custkey)), ',') AS all_s FROM orders", O, "SELECT DISTINCT o_custkey, ARRAY_JOIN(SORT_ARRAY(COLLECT_LIST(o_orderstatus) OVER (PARTITION BY o_custkey)), ',') AS all_s FROM db.orders"),
    _same("topn", O, "SELECT o_orderkey, o_totalprice FROM db.orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    _same("set_union", O, "SELECT o_orderstatus AS x FROM db.orders UNION SELECT o_orderpriority FROM db.orders"),
    _same("set_union_all", O, "SELECT o_orderkey AS k FROM db.orders UNION ALL SELECT o_custkey FROM db.orders"),
    Query("set_union_by_name", "SELECT o_orderkey AS k, o_orderstatus AS s, NULL AS p FROM orders UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders", O, make=_union_by_name),
    _same("set_intersect", O + C, "SELECT o_custkey AS k FROM db.orders INTERSECT SELECT c_custkey FROM db.customer WHERE c_acctbal > 0"),
    _same("set_except", O + C, "SELECT c_custkey AS k FROM db.customer EXCEPT SELECT o_custkey FROM db.orders"),
    _same("set_intersect_all", O + C, "SELECT o_custkey AS k FROM db.orders INTERSECT ALL SELECT c_custkey FROM db.customer"),
    _same("set_except_all", O + C, "SELECT o_custkey AS k FROM db.orders EXCEPT ALL SELECT c_custkey FROM db.customer"),
    _same("join_natural", ("nation", "region"), "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM db.nation) a NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM db.region) b"),
    _same("join_lateral", C + O, "SELECT c.c_custkey, x.top FROM db.customer c, LATERAL (SELECT MAX(o.o_totalprice) AS top FROM db.orders o WHERE o.o_custkey = c.c_custkey) x"),
    _same("win_distribution", O, "SELECT o_orderkey, ROUND(PERCENT_RANK() OVER w, 9) AS pr, ROUND(CUME_DIST() OVER w, 9) AS cd, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_k FROM db.orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)"),
    _same("win_range_frame", O, "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM db.orders"),
    _same("cte_subquery", O, "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM db.orders WHERE o_totalprice > 100000 GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM big WHERE n > (SELECT AVG(n) FROM big) GROUP BY n"),
    _same("fn_string", C, "SELECT c_custkey, UPPER(c_name) AS u, LENGTH(c_mktsegment) AS n, SUBSTRING(c_name, 2, 4) AS s, c_name || '-' || c_mktsegment AS j, REPLACE(c_mktsegment, 'A', 'x') AS r, TRIM('  x ') AS t, LPAD(CAST(c_custkey AS VARCHAR(10)), 6, '0') AS p FROM db.customer".replace("LENGTH(c_mktsegment)", "CAST(LENGTH(c_mktsegment) AS BIGINT)")),
    Query("fn_date", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS later, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS n FROM orders", O, "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DATE_ADD(CAST(o_orderdate AS DATE), 30) AS later, CAST(DATE_TRUNC('MONTH', o_orderdate) AS DATE) AS first, DATEDIFF(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS n FROM db.orders"),
    _same("fn_math", O, "SELECT o_orderkey, ABS(o_totalprice - 100000) AS a, CAST(FLOOR(o_totalprice) AS BIGINT) AS f, CAST(CEIL(o_totalprice) AS BIGINT) AS c, o_orderkey % 7 AS m, SQRT(CAST(o_orderkey AS DOUBLE)) AS r, COALESCE(NULLIF(o_orderkey % 2, 0), -1) AS z FROM db.orders"),
    Query("fn_array", "SELECT o_orderkey, [o_orderstatus, o_orderpriority][1] AS one, list_contains([o_orderstatus, 'F'], 'O') AS has, CAST(len(string_split(o_orderpriority, '-')) AS INTEGER) AS n FROM orders", O, "SELECT o_orderkey, ELEMENT_AT(ARRAY(o_orderstatus, o_orderpriority), 1) AS one, ARRAY_CONTAINS(ARRAY(o_orderstatus, 'F'), 'O') AS has, SIZE(SPLIT(o_orderpriority, '-')) AS n FROM db.orders"),
    Query("fn_map", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS f FROM orders", O, "SELECT o_orderkey, MAP(o_orderstatus, o_custkey)['F'] AS f FROM db.orders"),
    Query("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", E, "SELECT event_id, GET_JSON_OBJECT(props, '$.k') AS k FROM db.events"),
    Query("fn_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", O, "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM db.orders"),
    Query("template_query", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'", O, make=_templates),
    Query("import_rows", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey", make=_import),
]
