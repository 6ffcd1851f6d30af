"""Builders for the DuckDB SQL used as the correctness oracle.

The oracle strings are plain ANSI/DuckDB SQL over the pre-registered views;
these helpers only write the repetitive parts (one UNION ALL branch per
column) from a column list.
"""

from __future__ import annotations

# Columns and storage classes of the driver's tables that the catalogue
# profiles.  (name, storage class) in file order.
TABLE_COLUMNS = {
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
               ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"),
                 ("c_acctbal", "numeric"), ("c_mktsegment", "string")],
    "events": [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"),
               ("event_type", "string"), ("value", "numeric"), ("props", "string")],
    "pages": [("page_id", "numeric"), ("url", "string"), ("html", "string")],
    "part": [("p_partkey", "numeric"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "numeric"), ("p_retailprice", "numeric")],
    "documents": [("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "numeric")],
    "conversations": [("conv_id", "numeric"), ("turn", "numeric"), ("role", "string"), ("text", "string")],
    "lineitem": [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
                 ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
                 ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "datetime")],
}


def type_case(kind: str, nn: str, fn: str, cap: int = 1000, thr: int = 2) -> str:
    if kind == "numeric":
        body = f"CASE WHEN {fn} > {thr} THEN 'numeric' ELSE 'factor_s' END"
    elif kind == "string":
        body = f"CASE WHEN {fn} <= {cap} THEN 'factor_s' ELSE 'character' END"
    elif kind == "datetime":
        body = "'datetime'"
    elif kind == "boolean":
        body = "'binary'"
    else:
        body = "'uncertain data type'"
    return f"CASE WHEN {nn} = 0 THEN 'empty' ELSE {body} END"


def profile_sql(source: str, columns: list[tuple[str, str]], overrides: dict | None = None) -> str:
    """SQL for the registered profile query: one row per column."""
    overrides = overrides or {}
    parts = []
    for pos, (c, kind) in enumerate(columns):
        t = f"'{overrides[c]}'" if c in overrides else type_case(kind, "nn", "fn")
        num = kind == "numeric"
        mn = f"CAST(min({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        mx = f"CAST(max({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS col_name, CAST({pos} AS INTEGER) AS col_pos, dt AS col_datatype, n_rows,
       nn AS n_non_null, fn AS col_factornum,
       ROUND(CAST(fn AS DOUBLE) / (CAST(n_rows AS DOUBLE) + 1.0), 2) AS distinct_ratio,
       CASE WHEN n_rows > 0 THEN CAST(n_rows - nn AS DOUBLE) * 100.0 / CAST(n_rows AS DOUBLE) END AS missing_pct,
       min_value, max_value,
       CASE WHEN dt = 'numeric' THEN '(' || mnt || ', ' || mxt || ')'
            WHEN dt = 'factor_s' THEN '[' || array_to_string(cats, ', ') || ']'
            WHEN dt = 'character' THEN 'character'
            WHEN dt = 'empty' THEN 'empty'
            ELSE 'uncertain data type' END AS value_range
FROM (SELECT *, {t} AS dt FROM (
      SELECT count(*) AS n_rows, count({c}) AS nn, count(DISTINCT {c}) AS fn,
             {mn} AS min_value, {mx} AS max_value,
             CAST(min({c}) AS VARCHAR) AS mnt, CAST(max({c}) AS VARCHAR) AS mxt,
             CASE WHEN count(DISTINCT {c}) <= 1000
                  THEN list_sort(list(DISTINCT CAST({c} AS VARCHAR))) END AS cats
      FROM {source}))""")
    return "\nUNION ALL".join(parts)
