"""Catalogue of registered queries over the driver's tables.

Each entry is ``name -> (spark, sf_dir) -> DataFrame`` and, where the result
is expressible in SQL, a DuckDB oracle string with the same column names.
Every query reads whole tables; parameters are the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import profile as P
from cohortlab.plans.oracle import TABLE_COLUMNS, profile_sql

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


PROFILE_OUT = ["col_name", "col_pos", "col_datatype", "n_rows", "n_non_null", "col_factornum",
               "distinct_ratio", "missing_pct", "min_value", "max_value", "value_range"]


def _profile_table(table: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.profile(read(spark, sf_dir, table)).select(*PROFILE_OUT)
    return q


# ------------------------------------------------------------------ profiling
for _t in ("orders", "customer", "events", "lineitem"):
    register(f"profile_{_t}", profile_sql(_t, TABLE_COLUMNS[_t]))(_profile_table(_t))


# ------------------------------------------------------------------ helpers
from cohortlab.functions.columns import dec  # noqa: E402
from cohortlab.operators import cleanse as C  # noqa: E402
from cohortlab.operators import combine as J  # noqa: E402
from cohortlab.operators import features as FE  # noqa: E402
from cohortlab.sources import datasets as S  # noqa: E402


def _oracle_profile(table: str, overrides=None) -> str:
    return profile_sql(table, TABLE_COLUMNS[table], overrides)


def _ids_sql(table: str, key: str) -> str:
    """Dense row id in file order; the driver's tables are stored in key order."""
    return f"(SELECT *, CAST(row_number() OVER (ORDER BY {key}) - 1 AS BIGINT) AS _row_id FROM {table})"


def _fp_sql(cols: list[str]) -> str:
    txt = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in cols)
    return (f"CAST(sum(CAST(('0x' || substr(md5(concat_ws(chr(31), {txt})), 1, 15)) AS HUGEINT)) "
            f"AS DECIMAL(38,0))")


def _events_with_nulls(spark, sf_dir):
    """events with nulls injected: value missing on errors, props missing on
    errors and clicks (the driver's tables hold no nulls)."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
                    F.when(~F.col("event_type").isin("error", "click"), F.col("props")).alias("props"))


EVENTS_NULLS_SQL = """(SELECT event_id, ts, user_id, event_type,
       CASE WHEN event_type <> 'error' THEN value END AS value,
       CASE WHEN event_type NOT IN ('error', 'click') THEN props END AS props FROM events)"""


# ------------------------------------------------------------------ S1-S10
@register("shape_orders", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS INTEGER) AS n_cols FROM orders")
def q_shape(spark, sf_dir):
    return S.shape(read(spark, sf_dir, "orders"))


@register("preview_orders", f"SELECT * FROM {_ids_sql('orders', 'o_orderkey')} ORDER BY _row_id LIMIT 20")
def q_preview(spark, sf_dir):
    return S.preview(S.stamp_row_ids(read(spark, sf_dir, "orders")), 20)


@register("row_ids_customer", f"SELECT * FROM {_ids_sql('customer', 'c_custkey')}")
def q_row_ids(spark, sf_dir):
    return S.stamp_row_ids(read(spark, sf_dir, "customer"))


FP_CUST = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
FP_ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _fp_rows_sql(source: str, by: str, cols: list[str]) -> str:
    return (f"SELECT CAST({by} AS VARCHAR) AS dataset, count(*) AS n_rows, CAST({len(cols)} AS INTEGER) AS n_cols, "
            f"'{','.join(cols)}' AS col_list, {_fp_sql(cols)} AS fingerprint FROM {source} GROUP BY {by}")


FP_OLD_SQL = _fp_rows_sql("customer", "c_mktsegment", FP_CUST)
FP_NEW_SQL = (_fp_rows_sql("(SELECT * FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal < 0))",
                           "c_mktsegment", FP_CUST)
              + " UNION ALL " + _fp_rows_sql("orders", "o_orderpriority", FP_ORD))


def _fp_old(spark, sf_dir):
    return S.fingerprint(read(spark, sf_dir, "customer"), cols=FP_CUST, by="c_mktsegment")


def _fp_new(spark, sf_dir):
    cust = C.filter_expr(read(spark, sf_dir, "customer"),
                         "NOT ($c_mktsegment$ = 'BUILDING' AND $c_acctbal$ < 0)")
    return (S.fingerprint(cust, cols=FP_CUST, by="c_mktsegment")
            .unionByName(S.fingerprint(read(spark, sf_dir, "orders"), cols=FP_ORD, by="o_orderpriority")))


register("fingerprint_customer_segments", FP_OLD_SQL)(_fp_old)


@register("fingerprint_upsert", f"""
WITH old AS ({FP_OLD_SQL}), new AS ({FP_NEW_SQL})
SELECT * FROM old WHERE dataset NOT IN (SELECT dataset FROM new) UNION ALL SELECT * FROM new""")
def q_fp_upsert(spark, sf_dir):
    return S.upsert_fingerprints(_fp_old(spark, sf_dir), _fp_new(spark, sf_dir))


@register("change_detection", f"""
WITH old AS ({FP_OLD_SQL}), new AS ({FP_NEW_SQL})
SELECT n.dataset, n.n_rows, n.fingerprint,
       CASE WHEN o.fingerprint IS NULL THEN 'new'
            WHEN o.fingerprint <> n.fingerprint OR o.n_rows <> n.n_rows OR o.col_list <> n.col_list THEN 'changed'
            ELSE 'same' END AS status
FROM new n LEFT JOIN old o ON n.dataset = o.dataset""")
def q_changes(spark, sf_dir):
    return S.detect_changes(_fp_old(spark, sf_dir), _fp_new(spark, sf_dir))


# the same over every column of the tables
WHOLE_CUST, WHOLE_ORD = ([c for c, _ in TABLE_COLUMNS[t]] for t in ("customer", "orders"))
FP_WHOLE_OLD_SQL = _fp_rows_sql("customer", "c_mktsegment", WHOLE_CUST)
FP_WHOLE_NEW_SQL = (_fp_rows_sql("(SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN -c_acctbal ELSE c_acctbal END "
                                 "AS c_acctbal) FROM customer)", "c_mktsegment", WHOLE_CUST)
                    + " UNION ALL " + _fp_rows_sql("orders", "o_orderpriority", WHOLE_ORD))


def _fp_whole_old(spark, sf_dir):
    return S.fingerprint(read(spark, sf_dir, "customer"), cols=WHOLE_CUST, by="c_mktsegment")


def _fp_whole_new(spark, sf_dir):
    balance = F.when(F.col("c_mktsegment") == "BUILDING", -F.col("c_acctbal")).otherwise(F.col("c_acctbal"))
    cust = read(spark, sf_dir, "customer").withColumn("c_acctbal", balance)
    return (S.fingerprint(cust, cols=WHOLE_CUST, by="c_mktsegment")
            .unionByName(S.fingerprint(read(spark, sf_dir, "orders"), cols=WHOLE_ORD, by="o_orderpriority")))


register("fingerprint_customer_segments_whole", FP_WHOLE_OLD_SQL)(_fp_whole_old)


@register("fingerprint_upsert_whole", f"""
WITH old AS ({FP_WHOLE_OLD_SQL}), new AS ({FP_WHOLE_NEW_SQL})
SELECT * FROM old WHERE dataset NOT IN (SELECT dataset FROM new) UNION ALL SELECT * FROM new""")
def q_fp_upsert_whole(spark, sf_dir):
    return S.upsert_fingerprints(_fp_whole_old(spark, sf_dir), _fp_whole_new(spark, sf_dir))


@register("change_detection_whole", f"""
WITH old AS ({FP_WHOLE_OLD_SQL}), new AS ({FP_WHOLE_NEW_SQL})
SELECT n.dataset, n.n_rows, n.fingerprint,
       CASE WHEN o.fingerprint IS NULL THEN 'new'
            WHEN o.fingerprint <> n.fingerprint OR o.n_rows <> n.n_rows OR o.col_list <> n.col_list THEN 'changed'
            ELSE 'same' END AS status
FROM new n LEFT JOIN old o ON n.dataset = o.dataset""")
def q_changes_whole(spark, sf_dir):
    return S.detect_changes(_fp_whole_old(spark, sf_dir), _fp_whole_new(spark, sf_dir))


# by column: one renamed, one changed, one with nulls, one dropped, one added
def _digest_rows_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS col_pos, '{c}' AS col_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        f"CAST(coalesce(sum(CAST(('0x' || substr(md5(CAST({c} AS VARCHAR)), 1, 15)) AS HUGEINT)), 0) AS DECIMAL(38,0)) AS digest FROM {source}"
        for i, c in enumerate(cols))


CHANGED_CUST_SQL = """(SELECT c_custkey, c_name AS c_label, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END AS c_nationkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN -c_acctbal ELSE c_acctbal END AS c_acctbal, c_custkey % 2 AS c_odd FROM customer)"""


@register("column_changes_customer", f"""
WITH o AS ({_digest_rows_sql('customer', WHOLE_CUST)}),
n AS ({_digest_rows_sql(CHANGED_CUST_SQL, ['c_custkey', 'c_label', 'c_nationkey', 'c_acctbal', 'c_odd'])}),
lone_n AS (SELECT * FROM n WHERE col_name NOT IN (SELECT col_name FROM o)),
lone_o AS (SELECT * FROM o WHERE col_name NOT IN (SELECT col_name FROM n))
SELECT 'customer' AS dataset, n.col_name, CASE WHEN n.digest = o.digest AND n.n_null = o.n_null AND n.n_rows = o.n_rows THEN 'same'
  ELSE 'changed' END AS status, o.col_name AS old_name FROM n JOIN o ON n.col_name = o.col_name
UNION ALL
SELECT 'customer', coalesce(n.col_name, o.col_name), CASE WHEN o.col_name IS NULL THEN 'added' WHEN n.col_name IS NULL THEN 'removed'
  ELSE 'renamed' END, o.col_name
FROM lone_n n FULL OUTER JOIN lone_o o ON n.digest = o.digest AND n.n_null = o.n_null AND n.n_rows = o.n_rows""")
def q_column_changes(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    building = F.col("c_mktsegment") == "BUILDING"
    new = c.select("c_custkey", F.col("c_name").alias("c_label"), F.when(~building, F.col("c_nationkey")).alias("c_nationkey"),
                   F.when(building, -F.col("c_acctbal")).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                   (F.col("c_custkey") % 2).alias("c_odd"))
    return S.detect_column_changes(S.column_digests(c, "customer", method="md5"), S.column_digests(new, "customer", method="md5"))


def _scratch(spark, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    import uuid
    from cohortlab.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


ORD_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
              "o_orderpriority string")


def _exported_orders(spark, sf_dir) -> str:
    path = _scratch(spark, "orders-csv")
    S.export_csv(_orders_ids(spark, sf_dir), path, ordered=True)
    return path


@register("csv_round_trip_orders", f"SELECT * FROM {_ids_sql('orders', 'o_orderkey')}")
def q_round_trip(spark, sf_dir):
    """S5 export in row order, S2 read of the parts, S3 save, S4 overwrite that drops the profile, load."""
    ws = S.Workspace(spark, _scratch(spark, "workspace"))
    df = ws.save(S.read_csv(spark, _exported_orders(spark, sf_dir), schema=ORD_SCHEMA), "df_orders")
    ws.save_profile(P.profile(df), "df_orders")
    out = ws.save(df, "df_orders")
    if ws.load_profile("df_orders") is not None:
        raise AssertionError("the overwritten dataset kept its profile")
    return out


@register("csv_first_rows_orders", f"SELECT * FROM {_ids_sql('orders', 'o_orderkey')} WHERE _row_id < 1000")
def q_first_rows(spark, sf_dir):
    """The first 1000 rows of a folder of CSV parts, in file order."""
    return S.read_csv(spark, _exported_orders(spark, sf_dir), nrows=1000, schema=ORD_SCHEMA)


@register("create_dataset_orders", f"SELECT _row_id, o_orderkey, o_totalprice, o_orderpriority FROM {_ids_sql('orders', 'o_orderkey')}")
def q_create_dataset(spark, sf_dir):
    """A new dataset from chosen columns, stored beside its source."""
    from cohortlab.plans import flows
    ws = S.Workspace(spark, _scratch(spark, "workspace"))
    ws.save(_orders_ids(spark, sf_dir), "df_orders")
    flows.column_action(ws, "df_orders", ["o_orderkey", "o_totalprice", "o_orderpriority"], "CREATE", "df_prices")
    return ws.load("df_prices")


def _table_fp(df, name):
    return S.fingerprint(df, name=name)


def _all_cols_fp_sql(name: str, source: str, cols: list[str]) -> str:
    return (f"SELECT '{name}' AS dataset, CAST({len(cols)} AS INTEGER) AS n_cols, {_fp_sql(cols)} AS fingerprint "
            f"FROM {source}")


@register("stale_profiles", f"""
WITH cur AS ({_all_cols_fp_sql('orders', 'orders', [c for c, _ in TABLE_COLUMNS['orders']])}
             UNION ALL {_all_cols_fp_sql('customer', 'customer', [c for c, _ in TABLE_COLUMNS['customer']])}
             UNION ALL {_all_cols_fp_sql('events', 'events', [c for c, _ in TABLE_COLUMNS['events']])}
             UNION ALL {_all_cols_fp_sql('lineitem', 'lineitem', [c for c, _ in TABLE_COLUMNS['lineitem']])}),
     reg AS ({_all_cols_fp_sql('orders', 'orders', [c for c, _ in TABLE_COLUMNS['orders']])}
             UNION ALL {_all_cols_fp_sql('customer', 'customer', [c for c, _ in TABLE_COLUMNS['customer']])}
             UNION ALL {_all_cols_fp_sql('events', "(SELECT * FROM events WHERE event_type <> 'error')",
                                         [c for c, _ in TABLE_COLUMNS['events']])}),
     prof AS (SELECT 'orders' AS dataset, count(*) AS n FROM ({_oracle_profile('orders')})
              UNION ALL SELECT 'customer', count(*) FROM ({_oracle_profile('customer')}) WHERE col_name <> 'c_acctbal'),
     j AS (SELECT c.dataset, c.n_cols, c.fingerprint, r.fingerprint AS reg_fp, p.n AS prof_rows
           FROM cur c LEFT JOIN reg r ON c.dataset = r.dataset LEFT JOIN prof p ON c.dataset = p.dataset)
SELECT dataset, reason, reason <> 'fresh' AS stale FROM (
  SELECT dataset, CASE WHEN reg_fp IS NULL OR reg_fp <> fingerprint THEN 'changed'
                       WHEN prof_rows IS NULL THEN 'no_profile'
                       WHEN prof_rows <> n_cols THEN 'column_count'
                       ELSE 'fresh' END AS reason FROM j)""")
def q_stale(spark, sf_dir):
    o, c, e, li = (read(spark, sf_dir, t) for t in ("orders", "customer", "events", "lineitem"))
    current = (_table_fp(o, "orders").unionByName(_table_fp(c, "customer"))
               .unionByName(_table_fp(e, "events")).unionByName(_table_fp(li, "lineitem")))
    registry = (_table_fp(o, "orders").unionByName(_table_fp(c, "customer"))
                .unionByName(_table_fp(e.filter(F.col("event_type") != "error"), "events")))
    profiles = P.query_profiles({"orders": P.profile(o),
                                 "customer": P.profile(c).filter(F.col("col_name") != "c_acctbal")})
    return S.stale_profiles(current, registry, profiles)


# ------------------------------------------------------------------ P7-P12
HIST_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _hist_sql(c: str) -> str:
    return f"""
SELECT '{c}' AS col_name, g.bin, g.lo + g.bin * ((g.hi - g.lo) / CAST(10 AS DOUBLE)) AS bin_lo,
       CASE WHEN g.bin = 9 THEN g.hi ELSE g.lo + (g.bin + 1) * ((g.hi - g.lo) / CAST(10 AS DOUBLE)) END AS bin_hi,
       CAST(coalesce(k.cnt, 0) AS BIGINT) AS cnt
FROM (SELECT CAST(b AS INTEGER) AS bin, lo, hi FROM
        (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
         FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem) WHERE v IS NOT NULL),
        range(0, 10) t(b)) g
LEFT JOIN (SELECT bin, count(*) AS cnt FROM (
             SELECT CAST(least(floor((v - lo) * CAST(10 AS DOUBLE) / (hi - lo)), 9) AS INTEGER) AS bin
             FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem) x,
                  (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo,
                          CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi FROM lineitem) r
             WHERE v IS NOT NULL) GROUP BY bin) k ON g.bin = k.bin"""


@register("histogram_lineitem", "SELECT col_name, bin, CAST(round(bin_lo, 6) AS DECIMAL(38,6)) AS bin_lo, "
          "CAST(round(bin_hi, 6) AS DECIMAL(38,6)) AS bin_hi, cnt FROM ("
          + " UNION ALL ".join(_hist_sql(c) for c in HIST_COLS) + ")")
def q_hist(spark, sf_dir):
    h = P.histogram(read(spark, sf_dir, "lineitem"), HIST_COLS)
    return h.select("col_name", "bin", dec(F.col("bin_lo")).alias("bin_lo"), dec(F.col("bin_hi")).alias("bin_hi"), "cnt")


WHOLE_HIST_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *HIST_COLS]


@register("histogram_lineitem_whole", "SELECT col_name, bin, CAST(round(bin_lo, 6) AS DECIMAL(38,6)) AS bin_lo, "
          "CAST(round(bin_hi, 6) AS DECIMAL(38,6)) AS bin_hi, cnt FROM ("
          + " UNION ALL ".join(_hist_sql(c) for c in WHOLE_HIST_COLS) + ")")
def q_hist_whole(spark, sf_dir):
    h = P.histogram(read(spark, sf_dir, "lineitem"), WHOLE_HIST_COLS)
    return h.select("col_name", "bin", dec(F.col("bin_lo")).alias("bin_lo"), dec(F.col("bin_hi")).alias("bin_hi"), "cnt")


def _box_sql(c: str) -> str:
    return f"""
SELECT '{c}' AS col_name, CAST(q.n AS BIGINT) AS n, q.q1, q.median, q.q3,
       min(CASE WHEN v >= q.q1 - 1.5 * (q.q3 - q.q1) THEN v END) AS whisker_lo,
       max(CASE WHEN v <= q.q3 + 1.5 * (q.q3 - q.q1) THEN v END) AS whisker_hi,
       CAST(count(CASE WHEN v < q.q1 - 1.5 * (q.q3 - q.q1) OR v > q.q3 + 1.5 * (q.q3 - q.q1) THEN 1 END) AS BIGINT) AS n_outliers
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem WHERE {c} IS NOT NULL) x,
     (SELECT count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
             quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3
      FROM lineitem) q
GROUP BY q.n, q.q1, q.median, q.q3"""


@register("box_lineitem", "SELECT col_name, n, " + ", ".join(
    f"CAST(round({k}, 6) AS DECIMAL(38,6)) AS {k}" for k in ("q1", "median", "q3", "whisker_lo", "whisker_hi"))
    + ", n_outliers FROM (" + " UNION ALL ".join(_box_sql(c) for c in HIST_COLS) + ")")
def q_box(spark, sf_dir):
    b = P.box_summary(read(spark, sf_dir, "lineitem"), HIST_COLS)
    return b.select("col_name", "n", *[dec(F.col(k)).alias(k) for k in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                    "n_outliers")


@register("box_lineitem_whole", "SELECT col_name, n, " + ", ".join(
    f"CAST(round({k}, 6) AS DECIMAL(38,6)) AS {k}" for k in ("q1", "median", "q3", "whisker_lo", "whisker_hi"))
    + ", n_outliers FROM (" + " UNION ALL ".join(_box_sql(c) for c in WHOLE_HIST_COLS) + ")")
def q_box_whole(spark, sf_dir):
    b = P.box_summary(read(spark, sf_dir, "lineitem"), WHOLE_HIST_COLS)
    return b.select("col_name", "n", *[dec(F.col(k)).alias(k) for k in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                    "n_outliers")


@register("value_counts_orders", " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS val, count(*) AS cnt, "
    f"CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM orders GROUP BY {c}"
    for c in ("o_orderstatus", "o_orderpriority")))
def q_value_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return P.factor_value_counts(P.value_counts(o), P.profile(o))


@register("factor_values_events", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS col_name, CAST({c} AS VARCHAR) AS val FROM events WHERE {c} IS NOT NULL" for c in ("event_type", "user_id")))
def q_factor_values(spark, sf_dir):
    """P5 as rows: every value of the factor columns, one of them (user_id) forced."""
    e = read(spark, sf_dir, "events")
    return P.factor_values(e, P.tag(P.profile(e).filter(F.col("col_name").isin("event_type", "user_id", "value")), ["user_id"], "factor_s"))


RETAG = {"c_nationkey": "factor_s", "c_acctbal": "character"}


@register("retag_customer", _oracle_profile("customer", RETAG))
def q_retag(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return P.retag(c, P.profile(c), RETAG).select(*PROFILE_OUT)


def _counts_sql(c: str, where: str = "TRUE") -> str:
    return (f"SELECT 'customer' AS dataset, '{c}' AS col_name, CAST({c} AS VARCHAR) AS val, count(*) AS cnt, "
            f"CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM customer WHERE {where} GROUP BY {c}")


@register("retag_flow_counts_customer", _counts_sql("c_nationkey") + " UNION ALL " + _counts_sql("c_mktsegment") + " UNION ALL "
          + _counts_sql("c_name", "(SELECT count(DISTINCT c_name) FROM customer) <= 1000"))
def q_retag_flow(spark, sf_dir):
    """P6-P9 stored for customer, then P10: c_nationkey becomes a factor; the stored value counts."""
    from cohortlab.plans import flows
    ws = S.Workspace(spark, _scratch(spark, "workspace"))
    ws.save(read(spark, sf_dir, "customer"), "customer")
    flows.profile_datasets(ws, ["customer"])
    flows.retag_dataset(ws, "customer", {"c_nationkey": "factor_s"})
    return ws.load_distribution("counts", "customer")


@register("tag_events", f"""SELECT col_name, col_pos,
  CASE WHEN col_name IN ('user_id') THEN 'factor_s' ELSE col_datatype END AS col_datatype,
  n_rows, n_non_null, col_factornum, distinct_ratio, missing_pct, min_value, max_value, value_range
FROM ({_oracle_profile('events')})""")
def q_tag(spark, sf_dir):
    return P.tag(P.profile(read(spark, sf_dir, "events")), ["user_id"], "factor_s").select(*PROFILE_OUT)


Q_FIELDS = ["col_name", "col_datatype", "distinct_ratio", "min_value", "max_value"]


@register("query_profiles_numeric", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, {', '.join(Q_FIELDS)} FROM ({_oracle_profile(t)}) WHERE col_datatype = 'numeric'"
    for t in ("orders", "customer", "events")))
def q_query_profiles(spark, sf_dir):
    profs = {t: P.profile(read(spark, sf_dir, t)) for t in ("orders", "customer", "events")}
    return P.query_profiles(profs, dtype="numeric", fields=Q_FIELDS)


# ------------------------------------------------------------------ C1-C9
@register("drop_columns_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def q_drop(spark, sf_dir):
    return C.drop_columns(read(spark, sf_dir, "orders"), ["o_totalprice", "o_orderpriority"])


@register("keep_columns_customer", "SELECT c_custkey, c_mktsegment FROM customer")
def q_keep(spark, sf_dir):
    return C.keep_columns(read(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment"])


def _prof_filter_sql(table_sql_profile: str, where: str) -> str:
    return f"SELECT {', '.join(PROFILE_OUT)} FROM ({table_sql_profile}) WHERE {where}"


@register("columns_by_type_events", _prof_filter_sql(_oracle_profile("events"), "col_datatype IN ('factor_s')"))
def q_c4a(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return C.matching_columns(P.profile(e), data_type="factor_s").select(*PROFILE_OUT)


@register("columns_by_suffix_lineitem", _prof_filter_sql(_oracle_profile("lineitem"), "regexp_matches(col_name, 'key$')"))
def q_c4b(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return C.matching_columns(P.profile(li), name_suffix="key").select(*PROFILE_OUT)


@register("columns_by_distinct_ratio_orders", _prof_filter_sql(
    _oracle_profile("orders"), "CAST(col_factornum AS DOUBLE) / (CAST(n_rows AS DOUBLE) + 1.0) >= 0.5"))
def q_c4c(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return C.matching_columns(P.profile(o), min_distinct_ratio="0.5").select(*PROFILE_OUT)


EVENTS_NULL_COLS = [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"),
                    ("event_type", "string"), ("value", "numeric"), ("props", "string")]


@register("columns_by_non_missing_events", _prof_filter_sql(
    profile_sql(EVENTS_NULLS_SQL, EVENTS_NULL_COLS), "CAST(n_non_null AS DOUBLE) / CAST(n_rows AS DOUBLE) >= 0.7"))
def q_c4d(spark, sf_dir):
    e = _events_with_nulls(spark, sf_dir)
    return C.matching_columns(P.profile(e), min_non_missing=0.7).select(*PROFILE_OUT)


def _balance_sql(table: str, cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS val, count(*) AS cnt FROM {table} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)
    return f"""SELECT col_name, CASE WHEN count(*) > 1 THEN
        (ln(sum(CAST(cnt AS DOUBLE))) - sum(CAST(cnt AS DOUBLE) * ln(CAST(cnt AS DOUBLE))) / sum(CAST(cnt AS DOUBLE)))
        / ln(CAST(count(*) AS DOUBLE)) ELSE 0.0 END AS balance FROM ({parts}) GROUP BY col_name"""


@register("columns_by_balance_orders", f"""SELECT {', '.join('p.' + c for c in PROFILE_OUT)}
FROM ({_oracle_profile('orders')}) p JOIN ({_balance_sql('orders', [c for c, _ in TABLE_COLUMNS['orders']])}) b
  ON p.col_name = b.col_name WHERE b.balance >= 0.95""")
def q_c4e(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return C.matching_columns(P.profile(o), min_balance=0.95, df=o).select(*PROFILE_OUT)


REGEX = "^[A-Za-z#0-9]+$"


@register("columns_by_regex_customer", f"""SELECT {', '.join('p.' + c for c in PROFILE_OUT)}
FROM ({_oracle_profile('customer')}) p WHERE p.col_name IN (
  SELECT col_name FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, bool_and(regexp_matches(CAST({c} AS VARCHAR), '{REGEX}')) AS ok FROM customer "
    f"WHERE {c} IS NOT NULL" for c, _ in TABLE_COLUMNS["customer"]) + ") WHERE ok)")
def q_c4f(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return C.matching_columns(P.profile(c), value_regex=REGEX, df=c).select(*PROFILE_OUT)


@register("filter_expr_orders", "SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def q_c5(spark, sf_dir):
    return C.filter_expr(read(spark, sf_dir, "orders"), "$o_totalprice$ > 100000 AND $o_orderstatus$ = 'F'")


@register("filter_non_null_events", f"""SELECT * FROM {EVENTS_NULLS_SQL} WHERE
  (CAST(event_id IS NOT NULL AS INTEGER) + CAST(ts IS NOT NULL AS INTEGER) + CAST(user_id IS NOT NULL AS INTEGER)
   + CAST(event_type IS NOT NULL AS INTEGER) + CAST(value IS NOT NULL AS INTEGER)
   + CAST(props IS NOT NULL AS INTEGER)) / 6.0 >= 0.8""")
def q_c6(spark, sf_dir):
    return C.filter_non_null(_events_with_nulls(spark, sf_dir), 0.8)


ORD_NULL_CUST_SQL = """(SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS o_custkey,
  o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders)"""


def _orders_null_cust(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.withColumn("o_custkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")))


@register("filter_by_ids_orders", f"""SELECT * FROM {ORD_NULL_CUST_SQL} o
WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_c7(spark, sf_dir):
    ids = read(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return C.filter_by_ids(_orders_null_cust(spark, sf_dir), ids, key="o_custkey", ids_key="c_custkey")


@register("affected_orders", "SELECT CAST(count_if(o_totalprice > 100000) AS BIGINT) AS n_kept, "
          "CAST(count(*) AS BIGINT) AS n_rows FROM orders")
def q_c8(spark, sf_dir):
    return C.affected(read(spark, sf_dir, "orders"), "$o_totalprice$ > 100000")


@register("filter_by_function_customer", "SELECT * FROM customer WHERE c_acctbal > 0 AND c_name LIKE '%7'")
def q_c9(spark, sf_dir):
    return C.filter_by_function(read(spark, sf_dir, "customer"),
                                lambda d: (d["c_acctbal"] > 0) & d["c_name"].endswith("7"))


@register("filter_by_pandas_udf_customer", "SELECT * FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'MACHINERY'")
def q_c9_udf(spark, sf_dir):
    @F.pandas_udf("boolean")
    def rich_not_machinery(bal: pd.Series, seg: pd.Series) -> pd.Series:
        return (bal > 5000) & (seg != "MACHINERY")
    return C.filter_by_function(read(spark, sf_dir, "customer"), rich_not_machinery, ["c_acctbal", "c_mktsegment"])


# ------------------------------------------------------------------ J1-J3
@register("join_customer_nation", """SELECT c.c_nationkey, c.c_custkey, c.c_name, c.c_acctbal, c.c_mktsegment,
  n.n_name, n.n_regionkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q_j1(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.join_key(read(spark, sf_dir, "customer"), n, "c_nationkey", "inner")


@register("join_outer_customer_nation", """SELECT coalesce(c.c_nationkey, n.n_nationkey) AS c_nationkey,
  c.c_custkey, c.c_name AS name_l, c.c_acctbal, c.c_mktsegment, n.n_name AS name_r, n.n_regionkey
FROM (SELECT c_custkey, c_name, CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_nationkey END AS c_nationkey,
             c_acctbal, c_mktsegment FROM customer) c
FULL OUTER JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) n ON c.c_nationkey = n.n_nationkey""")
def q_j1_outer(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    c = c.select("c_custkey", F.col("c_name").alias("name"),
                 F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.col("c_nationkey")).alias("c_nationkey"),
                 "c_acctbal", "c_mktsegment")
    n = read(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 0) \
        .select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"), "n_regionkey")
    return J.join_key(c, n, "c_nationkey", "outer")


ORD_IDS = _ids_sql("orders", "o_orderkey")


def _orders_ids(spark, sf_dir):
    return S.stamp_row_ids(read(spark, sf_dir, "orders"))


@register("join_rows_orders", f"""SELECT l._row_id, l.o_orderkey AS o_orderkey_l, l.o_totalprice,
  r.o_orderkey AS o_orderkey_r, r.o_orderstatus
FROM {ORD_IDS} l JOIN (SELECT * FROM {ORD_IDS} WHERE o_orderstatus = 'F') r ON l._row_id = r._row_id""")
def q_j2(spark, sf_dir):
    o = _orders_ids(spark, sf_dir)
    left = C.keep_columns(o, ["o_orderkey", "o_totalprice"])
    right = C.keep_columns(C.filter_expr(o, "$o_orderstatus$ = 'F'"), ["o_orderkey", "o_orderstatus"])
    return J.join_rows(left, right)


@register("concat_columns_orders", f"""SELECT l._row_id, l.o_orderkey AS o_orderkey_l, l.o_totalprice,
  r.o_orderkey AS o_orderkey_r, r.o_orderstatus
FROM {ORD_IDS} l LEFT JOIN (SELECT * FROM {ORD_IDS} WHERE o_orderstatus = 'F') r ON l._row_id = r._row_id""")
def q_j3(spark, sf_dir):
    o = _orders_ids(spark, sf_dir)
    left = C.keep_columns(o, ["o_orderkey", "o_totalprice"])
    right = C.keep_columns(C.filter_expr(o, "$o_orderstatus$ = 'F'"), ["o_orderkey", "o_orderstatus"])
    return J.concat_columns(left, right)


# ------------------------------------------------------------------ F1-F5, L1-L2
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("one_hot_events", "SELECT _row_id, " + ", ".join(
    f"CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END AS drv_f_event_type_{v}" for v in EVENT_TYPES)
    + f" FROM {_ids_sql('events', 'event_id')}")
def q_f1(spark, sf_dir):
    return FE.explode_factors(S.stamp_row_ids(read(spark, sf_dir, "events")), ["event_type"])


@register("one_hot_lineitem", """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS drv_f_l_returnflag_A,
  CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS drv_f_l_returnflag_N,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS drv_f_l_returnflag_R,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS drv_f_l_linestatus_F,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS drv_f_l_linestatus_O FROM lineitem""")
def q_f1b(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    # carry the (non-unique) line keys so rows stay recognisable
    return FE.explode_factors(li, ["l_returnflag", "l_linestatus"], keep=["l_orderkey", "l_linenumber"])


def _orders_date_text(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    txt = F.date_format("o_orderdate", "yyyyMMdd")
    return o.select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", F.concat(txt, F.lit("x")))
                    .otherwise(txt).alias("o_orderdate"))


DATE_TEXT_SQL = """(SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%Y%m%d') || 'x'
  ELSE strftime(o_orderdate, '%Y%m%d') END AS o_orderdate FROM orders)"""


@register("parse_dates_orders", f"SELECT o_orderkey, CAST(try_strptime(o_orderdate, '%Y%m%d') AS DATE) AS o_orderdate "
          f"FROM {DATE_TEXT_SQL}")
def q_f2(spark, sf_dir):
    return FE.parse_dates(_orders_date_text(spark, sf_dir), ["o_orderdate"], "%Y%m%d")


@register("days_from_base_orders", f"""SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS _row_id,
  CAST(date_diff('day', CAST(try_strptime(o_orderdate, '%Y%m%d') AS DATE), DATE '1999-01-01') AS INTEGER) AS drv_d_o_orderdate
FROM {DATE_TEXT_SQL}""")
def q_f3(spark, sf_dir):
    parsed = FE.parse_dates(S.stamp_row_ids(_orders_date_text(spark, sf_dir)), ["o_orderdate"])
    return FE.days_from_base(parsed, ["o_orderdate"], "1999-01-01", inverse=True, prefix="drv_d_")


@register("derive_isnull_events", f"SELECT event_id, value IS NOT NULL AS value_present FROM {EVENTS_NULLS_SQL}")
def q_f4(spark, sf_dir):
    return FE.derive_one(_events_with_nulls(spark, sf_dir), "value", "isnull", "value_present") \
        .select("event_id", "value_present")


MM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_const"]


@register("min_max_lineitem", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CAST(round((CAST({c} AS DOUBLE) - min({c}) OVER ()) / CASE WHEN max({c}) OVER () - min({c}) OVER () = 0 "
    f"THEN 1.0 ELSE max({c}) OVER () - min({c}) OVER () END, 9) AS DECIMAL(38,9)) AS {c}" for c in MM_COLS)
    + " FROM (SELECT *, CAST(5.0 AS DOUBLE) AS l_const FROM lineitem)")
def q_f5(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *MM_COLS[:-1],
                                                  F.lit(5.0).alias("l_const"))
    out = FE.min_max(li, MM_COLS)
    return out.select("l_orderkey", "l_linenumber", *[dec(F.col(c), 9).alias(c) for c in MM_COLS])


@register("split_label_lineitem", "SELECT l_discount, l_extendedprice, l_linenumber, l_orderkey, l_partkey, "
          "l_quantity, l_suppkey, l_tax FROM lineitem")
def q_l1(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").drop("l_linestatus", "l_shipdate")
    x, _, _ = FE.split_label(li, "l_returnflag")          # features sorted by name, label apart
    return x


@register("recode_label_lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber > 1 AS INTEGER) AS y_sel, "
          "CAST(l_linenumber AS DOUBLE) - 1.0 AS y_risk FROM lineitem")
def q_l2(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    li = FE.recode_label(li, "l_linenumber", 1, out="y_sel")
    return FE.shift_label(li, "l_linenumber", 1.0, out="y_risk")


# ------------------------------------------------------------------ L3-L5
from cohortlab.operators import risk as R  # noqa: E402
from cohortlab.operators import select as SEL  # noqa: E402

IG_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linenumber"]
IG_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
DEC_LIST = "[" + ", ".join(str(i / 10) for i in range(1, 10)) + "]"


def _ig_input(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select(*IG_FEATS, (F.col("l_linestatus") == "F").cast("int").alias("y"))


def _ig_sql() -> str:
    qs = ", ".join(f"quantile_disc({c}, {DEC_LIST}) AS q_{c}, count(DISTINCT {c}) AS k_{c}" for c in IG_NUMERIC)
    disc = []
    for c in IG_FEATS:
        raw = f"coalesce(CAST({c} AS VARCHAR), '\\N')"
        if c in IG_NUMERIC:
            binned = " + ".join(f"CAST({c} > q_{c}[{j}] AS INTEGER)" for j in range(1, 10))
            disc.append(f"CASE WHEN k_{c} > 10 THEN (CASE WHEN {c} IS NULL THEN '\\N' ELSE 'b' || CAST({binned} AS VARCHAR) END) "
                        f"ELSE {raw} END AS {c}")
        else:
            disc.append(f"{raw} AS {c}")
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature_name, {c} AS val, y FROM disc" for c in IG_FEATS)
    return f"""WITH base AS (SELECT {', '.join(IG_FEATS)}, CAST(CAST(l_linestatus = 'F' AS INTEGER) AS VARCHAR) AS y FROM lineitem),
q AS (SELECT {qs} FROM lineitem),
disc AS (SELECT y, {', '.join(disc)} FROM base, q),
joint AS (SELECT feature_name, val, y, CAST(count(*) AS DOUBLE) AS n_vy FROM ({long}) GROUP BY feature_name, val, y),
by_y AS (SELECT feature_name, y, sum(n_vy) AS n_y FROM joint GROUP BY feature_name, y),
tot AS (SELECT feature_name, sum(n_y) AS n FROM by_y GROUP BY feature_name),
terms AS (SELECT j.feature_name, j.n_vy / t.n * ln(j.n_vy * t.n / (sum(j.n_vy) OVER (PARTITION BY j.feature_name, j.val) * b.n_y)) AS t
          FROM joint j JOIN by_y b ON j.feature_name = b.feature_name AND j.y = b.y JOIN tot t ON j.feature_name = t.feature_name)
SELECT feature_name, sum(t) AS feature_scores FROM terms GROUP BY feature_name"""


IG_SQL = _ig_sql()


def _ig(spark, sf_dir):
    return SEL.information_gain(_ig_input(spark, sf_dir), "y")


@register("information_gain_lineitem",
          f"SELECT feature_name, CAST(round(feature_scores, 9) AS DECIMAL(38,9)) AS feature_scores FROM ({IG_SQL})")
def q_l3(spark, sf_dir):
    return _ig(spark, sf_dir).select("feature_name", dec(F.col("feature_scores"), 9).alias("feature_scores"))


@register("select_top_features_lineitem",
          f"SELECT feature_name, CAST(round(feature_scores, 9) AS DECIMAL(38,9)) AS feature_scores FROM ({IG_SQL}) "
          f"ORDER BY feature_scores DESC, feature_name LIMIT 3")
def q_l4(spark, sf_dir):
    top = SEL.select_top(_ig(spark, sf_dir), k=3)
    return top.select("feature_name", dec(F.col("feature_scores"), 9).alias("feature_scores"))


@register("select_top_percentile_lineitem", f"""SELECT feature_name, CAST(round(feature_scores, 9) AS DECIMAL(38,9)) AS feature_scores FROM (
  SELECT *, row_number() OVER (ORDER BY feature_scores DESC, feature_name) AS rank, count(*) OVER () AS m FROM ({IG_SQL})) WHERE rank <= ceil(40 * m / 100.0)""")
def q_l4_percentile(spark, sf_dir):
    top = SEL.select_top(_ig(spark, sf_dir), percentile=40)
    return top.select("feature_name", dec(F.col("feature_scores"), 9).alias("feature_scores"))


@register("select_top_threshold_lineitem", f"""SELECT feature_name, CAST(round(feature_scores, 9) AS DECIMAL(38,9)) AS feature_scores FROM (
  SELECT *, row_number() OVER (ORDER BY feature_scores DESC, feature_name) AS rank, count(*) OVER () AS m FROM ({IG_SQL})) WHERE feature_scores >= 0.00001""")
def q_l4_threshold(spark, sf_dir):
    top = SEL.select_top(_ig(spark, sf_dir), threshold=0.00001)
    return top.select("feature_name", dec(F.col("feature_scores"), 9).alias("feature_scores"))


@register("rank_importance_lineitem", f"""SELECT feature_name, CAST(round(feature_scores, 9) AS DECIMAL(38,9)) AS feature_scores,
  CAST(round(abs(feature_scores), 9) AS DECIMAL(38,9)) AS abs_score,
  CASE WHEN feature_scores > 0 THEN 'pos' ELSE 'neg' END AS sign,
  CAST(row_number() OVER (ORDER BY abs(feature_scores) DESC, feature_name) AS INTEGER) AS rank FROM ({IG_SQL})""")
def q_l5(spark, sf_dir):
    r = SEL.rank_importance(_ig(spark, sf_dir))
    return r.select("feature_name", dec(F.col("feature_scores"), 9).alias("feature_scores"),
                    dec(F.col("abs_score"), 9).alias("abs_score"), "sign", "rank")


# ------------------------------------------------------------------ R1, R6-R8
def _split_sql(source: str, label: str, id_col: str, ratio: float, seed: int) -> str:
    return f"""(SELECT *, CASE WHEN _rn <= _k THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || CAST({id_col} AS VARCHAR)), {id_col}) AS _rn,
         CAST(round(count(*) OVER (PARTITION BY {label}) * {ratio}) AS BIGINT) AS _k FROM {source}))"""


@register("stratified_split_orders",
          f"SELECT o_orderkey, o_orderstatus, split FROM {_split_sql('orders', 'o_orderstatus', 'o_orderkey', 0.2, 42)}")
def q_r1(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return R.stratified_split(o, "o_orderstatus", "o_orderkey", 0.2, seed=42)


DOCS_SQL = """(SELECT l.doc_id, l.toxic,
  (CAST(d.n_chars AS DOUBLE) - min(CAST(d.n_chars AS DOUBLE)) OVER ()) /
  CASE WHEN max(CAST(d.n_chars AS DOUBLE)) OVER () - min(CAST(d.n_chars AS DOUBLE)) OVER () = 0 THEN 1.0
       ELSE max(CAST(d.n_chars AS DOUBLE)) OVER () - min(CAST(d.n_chars AS DOUBLE)) OVER () END AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
SCORED_DOCS_SQL = _split_sql(DOCS_SQL, "toxic", "doc_id", 0.2, 7)


def _scored_docs(spark, sf_dir):
    """Labelled documents scored by their (min-max scaled) length, split R1-style."""
    lab = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("p"))
    scored = FE.min_max(J.join_key(lab, docs, "doc_id", "inner"), ["p"])
    return R.stratified_split(scored, "toxic", "doc_id", 0.2, seed=7)


def _dec_sql(c: str, s: int = 9) -> str:
    return f"CAST(round({c}, {s}) AS DECIMAL(38,{s})) AS {c}"


@register("threshold_metrics_docs", f"""SELECT split, tp, fp, tn, fn, {_dec_sql('accuracy')}, {_dec_sql('precision')},
  {_dec_sql('recall')}, {_dec_sql('specificity')}, {_dec_sql('f1')} FROM (
  SELECT split, tp, fp, tn, fn,
    CASE WHEN tp + fp + tn + fn <> 0 THEN CAST(tp + tn AS DOUBLE) / CAST(tp + fp + tn + fn AS DOUBLE) END AS accuracy,
    CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
    CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
    CASE WHEN tn + fp <> 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END AS specificity,
    CASE WHEN tp + fp <> 0 AND tp + fn <> 0 AND tp > 0
         THEN 2 * (CAST(tp AS DOUBLE) / (tp + fp)) * (CAST(tp AS DOUBLE) / (tp + fn))
              / ((CAST(tp AS DOUBLE) / (tp + fp)) + (CAST(tp AS DOUBLE) / (tp + fn))) END AS f1
  FROM (SELECT split, CAST(count_if(toxic > 0 AND p >= 0.5) AS BIGINT) AS tp,
               CAST(count_if(NOT toxic > 0 AND p >= 0.5) AS BIGINT) AS fp,
               CAST(count_if(NOT toxic > 0 AND NOT p >= 0.5) AS BIGINT) AS tn,
               CAST(count_if(toxic > 0 AND NOT p >= 0.5) AS BIGINT) AS fn
        FROM {SCORED_DOCS_SQL} GROUP BY split))""")
def q_r6(spark, sf_dir):
    m = R.threshold_metrics(_scored_docs(spark, sf_dir), "toxic", "p", "split", 0.5)
    return m.select("split", "tp", "fp", "tn", "fn",
                    *[dec(F.col(c), 9).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1")])


ROC_SQL = f"""WITH c AS (SELECT split, p AS threshold, count_if(toxic > 0) AS pos, count_if(NOT toxic > 0) AS neg
                FROM {SCORED_DOCS_SQL} GROUP BY split, p),
r AS (SELECT split, threshold, pos, neg,
             sum(pos) OVER (PARTITION BY split ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
             sum(neg) OVER (PARTITION BY split ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
             sum(pos) OVER (PARTITION BY split) AS P, sum(neg) OVER (PARTITION BY split) AS N FROM c)
SELECT split, threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, CAST(cum_pos AS BIGINT) AS cum_pos,
       CAST(cum_neg AS BIGINT) AS cum_neg,
       CASE WHEN N <> 0 THEN CAST(cum_neg AS DOUBLE) / CAST(N AS DOUBLE) END AS fpr,
       CASE WHEN P <> 0 THEN CAST(cum_pos AS DOUBLE) / CAST(P AS DOUBLE) END AS tpr FROM r
UNION ALL
SELECT split, NULL, 0, 0, 0, 0, CASE WHEN sum(neg) > 0 THEN 0.0 END, CASE WHEN sum(pos) > 0 THEN 0.0 END FROM c GROUP BY split"""


@register("roc_docs", f"SELECT split, {_dec_sql('threshold')}, pos, neg, cum_pos, cum_neg, {_dec_sql('fpr')}, "
          f"{_dec_sql('tpr')} FROM ({ROC_SQL})")
def q_r7(spark, sf_dir):
    roc = R.roc_points(_scored_docs(spark, sf_dir), "toxic", "p", "split")
    return roc.select("split", dec(F.col("threshold"), 9).alias("threshold"), "pos", "neg", "cum_pos", "cum_neg",
                      dec(F.col("fpr"), 9).alias("fpr"), dec(F.col("tpr"), 9).alias("tpr"))


@register("auc_docs", f"""SELECT split, {_dec_sql('auc')} FROM (
  SELECT split, CASE WHEN sum(pos) * sum(neg) <> 0 THEN
      sum(CAST(neg AS DOUBLE) * CAST(2 * cum_pos - pos AS DOUBLE) / 2.0) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))
    END AS auc FROM ({ROC_SQL}) GROUP BY split)""")
def q_r8(spark, sf_dir):
    a = R.auc(R.roc_points(_scored_docs(spark, sf_dir), "toxic", "p", "split"))
    return a.select("split", dec(F.col("auc"), 9).alias("auc"))


# ------------------------------------------------------------------ K1-K8
from cohortlab.operators import cluster as K  # noqa: E402

K_FEATS = ["l_quantity", "l_linenumber", "big_qty", "high_disc", "l_extendedprice"]


def _li_clusters(spark, sf_dir):
    """lineitem rows grouped by return flag (A/N/R -> 0/1/2) with derived
    0/1 features and the line status as outcome."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("cluster_id"),
        (F.col("l_linestatus") == "F").cast("int").alias("drv_lbl"),
        "l_quantity", (F.col("l_quantity") > 25).cast("int").alias("big_qty"),
        (F.col("l_discount") > 0.05).cast("int").alias("high_disc"), "l_extendedprice")


LI_CLUSTERS_SQL = """(SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS cluster_id,
  CAST(l_linestatus = 'F' AS INTEGER) AS drv_lbl, l_quantity, CAST(l_quantity > 25 AS INTEGER) AS big_qty,
  CAST(l_discount > 0.05 AS INTEGER) AS high_disc, l_extendedprice FROM lineitem)"""


def _k_long_sql(cast: str) -> str:
    return " UNION ALL ".join(f"SELECT cluster_id, '{c}' AS feature_name, {cast.format(c=c)} AS v FROM base"
                              for c in K_FEATS)


K_TYPES_SQL = f"""base AS {LI_CLUSTERS_SQL},
long_i AS ({_k_long_sql('CAST(trunc({c}) AS BIGINT)')}),
types AS (SELECT feature_name, count(DISTINCT v) AS n_distinct,
                 CASE WHEN count(DISTINCT v) = 2 THEN 'binary' WHEN count(DISTINCT v) <= 10 THEN 'categorical'
                      ELSE 'numeric' END AS feature_type
          FROM long_i WHERE v IS NOT NULL GROUP BY feature_name)"""


def _k_types(spark, sf_dir):
    d = _li_clusters(spark, sf_dir)
    return d, K.type_features(d, K_FEATS)


@register("feature_types_lineitem", f"WITH {K_TYPES_SQL} SELECT feature_name, n_distinct, feature_type FROM types")
def q_k4(spark, sf_dir):
    return _k_types(spark, sf_dir)[1]


@register("cluster_summary_lineitem", f"""WITH {K_TYPES_SQL},
means AS (SELECT l.cluster_id, l.feature_name, t.feature_type, avg(CAST(l.v AS DOUBLE)) AS value
          FROM long_i l JOIN types t ON l.feature_name = t.feature_name
          WHERE t.feature_type <> 'categorical' AND l.v IS NOT NULL GROUP BY ALL),
cnt AS (SELECT l.cluster_id, l.feature_name, t.feature_type, l.v, count(*) AS n
        FROM long_i l JOIN types t ON l.feature_name = t.feature_name
        WHERE t.feature_type = 'categorical' AND l.v IS NOT NULL GROUP BY ALL),
modes AS (SELECT cluster_id, feature_name, feature_type, CAST(v AS DOUBLE) AS value FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster_id, feature_name ORDER BY n DESC, v) AS r FROM cnt) WHERE r = 1)
SELECT cluster_id, feature_name, feature_type, CAST(round(value, 6) AS DECIMAL(38,6)) AS value
FROM (SELECT * FROM means UNION ALL SELECT * FROM modes)""")
def q_k4b(spark, sf_dir):
    d, types = _k_types(spark, sf_dir)
    s = K.cluster_summary(d, K_FEATS, types)
    return s.select("cluster_id", "feature_name", "feature_type", dec(F.col("value")).alias("value"))


@register("cluster_table_lineitem", f"""SELECT cluster_id, count(*) AS TOTAL,
  CAST(count_if(coalesce(drv_lbl <> 0, false)) AS BIGINT) AS POS_OUTCOME,
  CAST(count_if(coalesce(big_qty <> 0, false)) AS BIGINT) AS big_qty,
  CAST(count_if(coalesce(high_disc <> 0, false)) AS BIGINT) AS high_disc FROM {LI_CLUSTERS_SQL} GROUP BY cluster_id""")
def q_k5(spark, sf_dir):
    return K.cluster_table(_li_clusters(spark, sf_dir), "drv_lbl", ["big_qty", "high_disc"])


@register("cluster_significance_lineitem", f"""WITH {K_TYPES_SQL},
cat AS (SELECT l.feature_name, l.cluster_id, l.v, CAST(count(*) AS DOUBLE) AS o
        FROM long_i l JOIN types t ON l.feature_name = t.feature_name
        WHERE t.feature_type <> 'numeric' AND l.v IS NOT NULL GROUP BY ALL),
rows_t AS (SELECT feature_name, cluster_id, sum(o) AS r FROM cat GROUP BY ALL),
cols_t AS (SELECT feature_name, v, sum(o) AS c FROM cat GROUP BY ALL),
tot AS (SELECT feature_name, sum(r) AS n, count(*) AS n_r FROM rows_t GROUP BY ALL),
nc AS (SELECT feature_name, count(*) AS n_c FROM cols_t GROUP BY ALL),
chi AS (SELECT x.feature_name, 'chi2' AS test, sum(x.o * x.o * t.n / (r.r * cc.c)) - t.n AS statistic,
               CAST((t.n_r - 1) * (nc.n_c - 1) AS BIGINT) AS dof1, CAST(NULL AS BIGINT) AS dof2
        FROM cat x JOIN rows_t r ON x.feature_name = r.feature_name AND x.cluster_id = r.cluster_id
        JOIN cols_t cc ON x.feature_name = cc.feature_name AND x.v = cc.v
        JOIN tot t ON x.feature_name = t.feature_name JOIN nc ON x.feature_name = nc.feature_name
        GROUP BY x.feature_name, t.n, t.n_r, nc.n_c),
long_d AS ({_k_long_sql('CAST({c} AS DOUBLE)')}),
g AS (SELECT l.feature_name, l.cluster_id, CAST(count(*) AS DOUBLE) AS ng, avg(l.v) AS mg, var_pop(l.v) AS vg
      FROM long_d l JOIN types t ON l.feature_name = t.feature_name
      WHERE t.feature_type = 'numeric' AND l.v IS NOT NULL GROUP BY ALL),
grand AS (SELECT feature_name, sum(ng * mg) / sum(ng) AS gm, sum(ng) AS n, count(*) AS k FROM g GROUP BY ALL),
an AS (SELECT g.feature_name, 'anova' AS test,
              CASE WHEN k > 1 AND n > k AND sum(ng * vg) > 0
                   THEN (sum(ng * (mg - gm) * (mg - gm)) / (k - 1)) / (sum(ng * vg) / (n - k)) END AS statistic,
              CAST(k - 1 AS BIGINT) AS dof1, CAST(n - k AS BIGINT) AS dof2
       FROM g JOIN grand ON g.feature_name = grand.feature_name GROUP BY g.feature_name, n, k, gm)
SELECT x.feature_name, t.feature_type, x.test, CAST(round(x.statistic, 6) AS DECIMAL(38,6)) AS statistic, x.dof1, x.dof2
FROM (SELECT * FROM chi UNION ALL SELECT * FROM an) x JOIN types t ON x.feature_name = t.feature_name""")
def q_k6(spark, sf_dir):
    d, types = _k_types(spark, sf_dir)
    s = K.cluster_significance(d, K_FEATS, types)
    return s.select("feature_name", "feature_type", "test", dec(F.col("statistic")).alias("statistic"), "dof1", "dof2")


FIXED_RULES = [(0, 0, "`l_quantity` <= 25 AND `l_discount` <= 0.05"),
               (1, 1, "`l_quantity` > 25"),
               (2, 2, "`l_quantity` <= 25 AND `l_discount` > 0.05")]


@register("rules_apply_lineitem", """WITH m AS (
  SELECT CASE WHEN l_quantity <= 25 AND l_discount <= 0.05 THEN 0 WHEN l_quantity > 25 THEN 1
              WHEN l_quantity <= 25 AND l_discount > 0.05 THEN 2 END AS rule_no,
         CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS actual FROM lineitem),
r AS (SELECT * FROM (VALUES (0, 0, '`l_quantity` <= 25 AND `l_discount` <= 0.05'), (1, 1, '`l_quantity` > 25'),
                            (2, 2, '`l_quantity` <= 25 AND `l_discount` > 0.05')) v(rule_no, cluster_id, rule))
SELECT CAST(r.rule_no AS INTEGER) AS rule_no, CAST(r.cluster_id AS INTEGER) AS cluster_id, r.rule,
       CAST(coalesce(a.support, 0) AS BIGINT) AS support,
       CAST(round(CASE WHEN a.support > 0 THEN CAST(a.hit AS DOUBLE) / CAST(a.support AS DOUBLE) END, 6) AS DECIMAL(38,6)) AS confidence
FROM r LEFT JOIN (SELECT m.rule_no, count(*) AS support, count_if(m.actual = r2.cluster_id) AS hit
                  FROM m JOIN r r2 ON m.rule_no = r2.rule_no GROUP BY m.rule_no) a ON r.rule_no = a.rule_no""")
def q_k8(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn(
        "cluster_id", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    r = K.apply_rules(li, FIXED_RULES)
    return r.select("rule_no", "cluster_id", "rule", "support", dec(F.col("confidence")).alias("confidence"))


# rows-only: model fitting (results depend on the optimiser, not expressible in SQL)


@register("pca_embeddings")
def q_k1(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return K.reduce_pca(e, "embedding", k=5, keep=["vec_id", "label"])


def _emb_clusters(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    pcs = K.reduce_pca(e, "embedding", k=5, keep=["vec_id", "embedding"])
    return K.kmeans(pcs, [f"pc_{i}" for i in range(1, 6)], k=2, n_init=10, keep=["vec_id", "embedding"])[0]


@register("kmeans_embeddings")
def q_k2(spark, sf_dir):
    return _emb_clusters(spark, sf_dir).select("vec_id", "cluster_id")


@register("silhouette_embeddings")
def q_k3(spark, sf_dir):
    return K.silhouette(_emb_clusters(spark, sf_dir), "embedding")


@register("rules_mined_lineitem")
def q_k7(spark, sf_dir):
    d = _li_clusters(spark, sf_dir)
    feats = ["l_quantity", "l_linenumber", "big_qty", "high_disc", "l_extendedprice"]
    model, acc = K.mine_rules(d, feats, "cluster_id", min_samples_leaf=10, max_depth=10)
    return K.apply_tree_rules(d, model, feats).withColumn("train_accuracy", F.lit(float(acc)))


from cohortlab.operators import cart  # noqa: E402

SPLIT_COUNTS = " UNION ALL ".join(
    f"SELECT {i} AS f, '{c}' AS feature_name, CAST({c} AS DOUBLE) AS v, count(*) AS n, count_if(cluster_id = 0) AS a, "
    f"count_if(cluster_id = 1) AS b, count_if(cluster_id = 2) AS c FROM base GROUP BY {c}" for i, c in enumerate(K_FEATS))


@register("best_split_lineitem", f"""WITH base AS {LI_CLUSTERS_SQL}, cnt AS ({SPLIT_COUNTS}),
cum AS (SELECT f, feature_name, v, lead(v) OVER w AS nxt, sum(n) OVER w AS nl, sum(a) OVER w AS la, sum(b) OVER w AS lb, sum(c) OVER w AS lc,
  sum(n) OVER (PARTITION BY f) AS t, sum(a) OVER (PARTITION BY f) AS ta, sum(b) OVER (PARTITION BY f) AS tb, sum(c) OVER (PARTITION BY f) AS tc
  FROM cnt WINDOW w AS (PARTITION BY f ORDER BY v)),
g AS (SELECT *, ((CAST(la AS DOUBLE) * la + CAST(lb AS DOUBLE) * lb + CAST(lc AS DOUBLE) * lc) / nl
  + (CAST(ta - la AS DOUBLE) * (ta - la) + CAST(tb - lb AS DOUBLE) * (tb - lb) + CAST(tc - lc AS DOUBLE) * (tc - lc)) / (t - nl)
  - (CAST(ta AS DOUBLE) * ta + CAST(tb AS DOUBLE) * tb + CAST(tc AS DOUBLE) * tc) / t) / t AS gain
  FROM cum WHERE nl >= 10 AND t - nl >= 10)
SELECT feature_name, CAST(round(v + (nxt - v) / 2, 6) AS DECIMAL(38,6)) AS threshold, CAST(nl AS BIGINT) AS n_left, CAST(t - nl AS BIGINT) AS n_right,
  CAST(round(gain, 9) AS DECIMAL(38,9)) AS gain FROM g ORDER BY round(gain, 12) DESC, f, v LIMIT 1""")
def q_best_split(spark, sf_dir):
    """K7: the root of the exact tree: the best of all splits of all features."""
    tree = cart.grow_tree(_li_clusters(spark, sf_dir), K_FEATS, "cluster_id", min_samples_leaf=10, max_depth=1)
    root = tree.nodes[0]
    row = (K_FEATS[root.feature], float(root.threshold), tree.nodes[root.left].n, tree.nodes[root.left + 1].n, float(root.gain))
    out = spark.createDataFrame([row], "feature_name string, threshold double, n_left bigint, n_right bigint, gain double")
    return out.select("feature_name", dec(F.col("threshold")).alias("threshold"), "n_left", "n_right", dec(F.col("gain"), 9).alias("gain"))


@register("rules_exact_lineitem")
def q_k7_exact(spark, sf_dir):
    """K7 + K8: the exact tree's rules with support and confidence."""
    d = _li_clusters(spark, sf_dir)
    tree = cart.grow_tree(d, K_FEATS, "cluster_id", min_samples_leaf=10, max_depth=5)
    return cart.tree_rules_report(d, tree, "cluster_id").withColumn("train_accuracy", F.lit(tree.accuracy))


def _risk_input(spark, sf_dir):
    """orders: scaled total price and one-hot priority as features, status F
    as outcome, R1 split on the order key."""
    o = S.stamp_row_ids(read(spark, sf_dir, "orders"))
    hot = FE.explode_factors(o, ["o_orderpriority"], prefix="prio_", keep=["o_orderkey", "o_orderstatus", "o_totalprice"])
    data = FE.min_max(hot, ["o_totalprice"]).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    feats = ["o_totalprice"] + [c for c in hot.columns if c.startswith("prio_")]
    # the prepared table feeds fitting, scoring and evaluation: written once
    from cohortlab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return R.stratified_split(data, "y", "o_orderkey", 0.2, seed=1).checkpoint(eager=True), feats


@register("logistic_coefficients_orders")
def q_r2(spark, sf_dir):
    data, feats = _risk_input(spark, sf_dir)
    return R.coefficients(R.fit_logistic(data.filter(F.col("split") == "train"), feats, "y"), feats)


@register("forest_importance_orders")
def q_r3(spark, sf_dir):
    data, feats = _risk_input(spark, sf_dir)
    return R.coefficients(R.fit_forest(data.filter(F.col("split") == "train"), feats, "y", n_trees=20), feats)


@register("risk_scores_orders")
def q_r5(spark, sf_dir):
    data, feats = _risk_input(spark, sf_dir)
    model = R.fit_logistic(data.filter(F.col("split") == "train"), feats, "y")
    return R.score(model, data, feats).select("o_orderkey", "split", "y", "p")


@register("risk_metrics_orders")
def q_r6b(spark, sf_dir):
    data, feats = _risk_input(spark, sf_dir)
    model = R.fit_logistic(data.filter(F.col("split") == "train"), feats, "y")
    scored = R.score(model, data, feats)
    return R.threshold_metrics(scored, "y", "p", "split", 0.5).join(
        R.auc(R.roc_points(scored, "y", "p", "split")), "split")


# ------------------------------------------------------------------ flows (rows-only)
from cohortlab.plans import flows as FL  # noqa: E402


@register("risk_flow_orders")
def q_risk_flow(spark, sf_dir):
    """Flow C with the random-forest option on orders: AUC and metrics per split."""
    o = read(spark, sf_dir, "orders")
    o = o.select("o_orderkey", "o_totalprice", F.dayofweek("o_orderdate").cast("double").alias("o_dow"),
                 (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    out = FL.risk_flow(o, ["o_totalprice", "o_dow"], "y", "o_orderkey", 0.2, 0.5, "RF", seed=3, label_shift=None)
    return out["metrics"].join(out["auc"], "split")


# ------------------------------------------------------------------ more operator variants
@register("select_columns_customer", """SELECT * EXCLUDE (c_acctbal) FROM customer""")
def q_c4_apply(spark, sf_dir):
    """C4 applied to the data: keep the columns whose every value matches the regex."""
    c = read(spark, sf_dir, "customer")
    return C.select_columns(c, P.profile(c), value_regex=REGEX)


@register("columns_by_type_and_ratio_lineitem", _prof_filter_sql(
    _oracle_profile("lineitem"),
    "col_datatype IN ('numeric', 'factor_s') AND CAST(col_factornum AS DOUBLE) / (CAST(n_rows AS DOUBLE) + 1.0) >= 0.0001"))
def q_c4_and(spark, sf_dir):
    """C4 with two conditions combined (AND): a type list and a distinct ratio."""
    li = read(spark, sf_dir, "lineitem")
    return C.matching_columns(P.profile(li), data_type="numeric, factor_s",
                              min_distinct_ratio=0.0001).select(*PROFILE_OUT)


@register("cluster_pvalues_lineitem")
def q_k6_p(spark, sf_dir):
    """K6 with p-values (chi-square / F upper tails from commons-math)."""
    d, types = _k_types(spark, sf_dir)
    return K.p_values(K.cluster_significance(d, K_FEATS, types))


K6_SQL = ORACLE["cluster_significance_lineitem"].replace("CAST(round(x.statistic, 6) AS DECIMAL(38,6))", "x.statistic")


@register("cluster_tails_lineitem", f"""SELECT feature_name, test, CAST(round(ln(p), 6) AS DECIMAL(38,6)) AS ln_p FROM (
  SELECT feature_name, test, CASE
    WHEN test = 'chi2' AND dof1 % 2 = 0 THEN exp(-statistic / 2) *
      list_sum(list_transform(range(CAST(dof1 / 2 AS BIGINT)), lambda i: power(statistic / 2, i) / factorial(CAST(i AS INTEGER))))
    WHEN test = 'anova' AND dof1 = 2 THEN power(1 + 2 * statistic / dof2, -dof2 / 2.0) END AS p
  FROM ({K6_SQL}))""")
def q_k6_tails(spark, sf_dir):
    """K6 upper tails as logarithms, against the finite sum for even degrees of freedom and the closed form for two."""
    d, types = _k_types(spark, sf_dir)
    p = K.p_values(K.cluster_significance(d, K_FEATS, types))
    return p.select("feature_name", "test", dec(F.log("p_value")).alias("ln_p"))


@register("join_left_hot_keys", """SELECT n.n_nationkey, n.n_name, n.n_regionkey, c.c_custkey, c.c_name, c.c_acctbal, c.c_mktsegment
FROM nation n LEFT JOIN (SELECT CASE WHEN c_custkey % 3 = 0 THEN 7 WHEN c_nationkey > 3 THEN c_nationkey END AS n_nationkey, c_custkey,
  c_name, c_acctbal, c_mktsegment FROM customer) c ON n.n_nationkey = c.n_nationkey""")
def q_j1_left_hot(spark, sf_dir):
    """J1 left, a third of the right side under one key, keys without a match and null keys."""
    return J.join_key(read(spark, sf_dir, "nation"), _hot_customers(spark, sf_dir), "n_nationkey", "left", split_hot=True)


@register("join_right_hot_keys", """SELECT c.n_nationkey, c.c_custkey, c.c_name, c.c_acctbal, c.c_mktsegment, n.n_name, n.n_regionkey
FROM (SELECT * FROM nation WHERE n_regionkey <> 2) n RIGHT JOIN
 (SELECT CASE WHEN c_custkey % 3 = 0 THEN 7 WHEN c_nationkey > 3 THEN c_nationkey END AS n_nationkey, c_custkey,
  c_name, c_acctbal, c_mktsegment FROM customer) c ON n.n_nationkey = c.n_nationkey""")
def q_j1_right_hot(spark, sf_dir):
    n = read(spark, sf_dir, "nation").where("n_regionkey <> 2")
    return J.join_key(n, _hot_customers(spark, sf_dir), "n_nationkey", "right", split_hot=True)


def _hot_customers(spark, sf_dir):
    key = F.when(F.col("c_custkey") % 3 == 0, 7).when(F.col("c_nationkey") > 3, F.col("c_nationkey"))
    return read(spark, sf_dir, "customer").select(key.alias("n_nationkey"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@register("select_columns_flow_orders", "SELECT o_orderkey, o_totalprice FROM orders")
def q_select_columns_flow(spark, sf_dir):
    """C4 as a flow: stored profile, numeric columns with many values, kept in place."""
    ws = S.Workspace(spark, _scratch(spark, "workspace"))
    ws.save(read(spark, sf_dir, "orders"), "orders")
    FL.select_columns_to_dataset(ws, "orders", "REMAIN", data_type="numeric", min_distinct_ratio=0.5)
    return ws.load("orders")


@register("filter_by_ids_flow_orders", ORACLE["filter_by_ids_orders"])
def q_ids_flow(spark, sf_dir):
    """C7 as a flow between two stored datasets."""
    ws = S.Workspace(spark, _scratch(spark, "workspace"))
    ws.save(_orders_null_cust(spark, sf_dir), "orders")
    ws.save(read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "building")
    FL.filter_by_ids_to_dataset(ws, "orders", "building", "orders_building", key="o_custkey", ids_key="c_custkey")
    return ws.load("orders_building")


@register("select_features_flow_lineitem", ORACLE["select_top_features_lineitem"])
def q_features_flow(spark, sf_dir):
    """L1-L4 as a flow: a label of 1 and 2, recoded, the three best features saved."""
    ws = S.Workspace(spark, _scratch(spark, "workspace"))
    ws.save(_ig_input(spark, sf_dir).withColumn("y", F.col("y") + 1), "lines")
    chosen = FL.select_features_to_dataset(ws, "lines", "y", "lines_best", k=3)
    if len(ws.load("lines_best").columns) != 4:
        raise AssertionError("three features and the label were to be saved")
    return chosen.select("feature_name", dec(F.col("feature_scores"), 9).alias("feature_scores"))


# ------------------------------------------------------------------ scale-path variants (rows-only)
@register("profile_lineitem_approx")
def q_profile_approx(spark, sf_dir):
    """P1-P6 with HyperLogLog distinct counts: the value table is built only
    for columns under the factor cap (estimates differ from exact counts, so
    no SQL oracle)."""
    return P.profile(read(spark, sf_dir, "lineitem"), approx=True).select(*PROFILE_OUT)


@register("box_lineitem_approx")
def q_box_approx(spark, sf_dir):
    """P8 with bounded percentile sketches instead of exact ranks."""
    return P.box_summary(read(spark, sf_dir, "lineitem"), HIST_COLS, exact=False)


# ------------------------------------------------------------------ text tables
URL_REGEX = "^https?://"


@register("columns_by_regex_pages", f"""SELECT p.col_name, p.col_datatype, p.n_non_null, p.col_factornum
FROM ({_oracle_profile('pages')}) p WHERE p.col_name IN (
  SELECT col_name FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, bool_and(regexp_matches(CAST({c} AS VARCHAR), '{URL_REGEX}')) AS ok FROM pages "
    f"WHERE {c} IS NOT NULL" for c, _ in TABLE_COLUMNS["pages"]) + ") WHERE ok)")
def q_c4f_pages(spark, sf_dir):
    """C4f over whole web pages: the regex is tested against every full value."""
    pg = read(spark, sf_dir, "pages")
    return (C.matching_columns(P.profile(pg), value_regex=URL_REGEX, df=pg)
            .select("col_name", "col_datatype", "n_non_null", "col_factornum"))


@register("value_counts_conversations", f"""WITH prof AS ({_oracle_profile('conversations')})
SELECT col_name, val, cnt, CAST(cnt AS DOUBLE) / CAST(sum(cnt) OVER (PARTITION BY col_name) AS DOUBLE) AS share FROM (
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS val, count(*) AS cnt FROM conversations "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c, _ in TABLE_COLUMNS["conversations"]) + """) v
WHERE col_name IN (SELECT col_name FROM prof WHERE col_datatype = 'factor_s')""")
def q_p9_conv(spark, sf_dir):
    """P9 on conversation turns: value counts (whole texts) of factor columns."""
    cv = read(spark, sf_dir, "conversations")
    return P.factor_value_counts(P.value_counts(cv), P.profile(cv))


DOC_FIELDS = ["col_name", "col_pos", "col_datatype", "n_rows", "n_non_null", "col_factornum",
              "distinct_ratio", "missing_pct", "min_value", "max_value"]


@register("profile_documents", f"SELECT {', '.join(DOC_FIELDS)} FROM ({_oracle_profile('documents')})")
def q_profile_docs(spark, sf_dir):
    """P1-P6 over whole documents (distinct counts of full texts); the
    value listing of factor columns is left out of the compared fields."""
    return P.profile(read(spark, sf_dir, "documents")).select(*DOC_FIELDS)


@register("join_supplier_nation_region", """SELECT n.n_regionkey, s.s_nationkey, s.s_suppkey, s.s_name, s.s_acctbal,
  n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_j1_chain(spark, sf_dir):
    """J1 chained: supplier -> nation -> region, each an equi-join on a key."""
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    r = read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return J.join_key(J.join_key(read(spark, sf_dir, "supplier"), n, "s_nationkey"), r, "n_regionkey")


@register("value_counts_part", f"""WITH prof AS ({_oracle_profile('part')})
SELECT col_name, val, cnt, CAST(cnt AS DOUBLE) / CAST(sum(cnt) OVER (PARTITION BY col_name) AS DOUBLE) AS share FROM (
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS val, count(*) AS cnt FROM part "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c, _ in TABLE_COLUMNS["part"]) + """) v
WHERE col_name IN (SELECT col_name FROM prof WHERE col_datatype = 'factor_s')""")
def q_p9_part(spark, sf_dir):
    """P9 on parts: value counts and shares of the factor columns."""
    pt = read(spark, sf_dir, "part")
    return P.factor_value_counts(P.value_counts(pt), P.profile(pt))
