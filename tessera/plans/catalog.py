"""Registered queries: one Spark callable per operator, plus the DuckDB SQL
that computes the same result independently (where SQL can express it).

Every query reads the provided tables (or data Spark derives from them)
in full.  Column names and types are aligned with the SQL side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clean, profile
from tessera.plans.fixtures import derived, derived_sql, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# SQL building blocks (DuckDB dialect)
# ---------------------------------------------------------------------------

NUMERIC_DUCK = ("'TINYINT','SMALLINT','INTEGER','BIGINT','HUGEINT','UTINYINT','USMALLINT',"
                "'UINTEGER','UBIGINT','FLOAT','DOUBLE','BOOLEAN'")
DATE_STRPTIME = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d",
                 "%m/%d/%Y", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y"]


def _q(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def _sql_types(src: str, strings: list[str]) -> str:
    """(position, column, semantic_type) for the relation ``src``."""
    desc = f"SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS col, column_type AS ty FROM (DESCRIBE SELECT * FROM {src})"
    if strings:
        casts = ", ".join(f"CAST({_q(c)} AS VARCHAR) AS {_q(c)}" for c in strings)
        fmt_ok = " OR ".join(f"count(*) FILTER (WHERE try_strptime(val, '{f}') IS NULL) = 0" for f in DATE_STRPTIME)
        stats = (f"SELECT col, count(*) AS nn, count(DISTINCT val) AS nu, ({fmt_ok}) AS is_date "
                 f"FROM (UNPIVOT (SELECT {casts} FROM {src}) ON {', '.join(_q(c) for c in strings)} "
                 f"INTO NAME col VALUE val) GROUP BY col")
    else:
        stats = "SELECT NULL::VARCHAR AS col, 0::BIGINT AS nn, 0::BIGINT AS nu, true AS is_date WHERE false"
    return f"""
SELECT d.position, d.col AS "column",
  CASE WHEN d.ty LIKE 'TIMESTAMP%' OR d.ty = 'DATE' THEN 'datetime'
       WHEN d.ty IN ({NUMERIC_DUCK}) OR d.ty LIKE 'DECIMAL%' THEN 'numeric'
       WHEN coalesce(s.is_date, true) THEN 'datetime'
       WHEN coalesce(s.nn, 0) > 0 AND s.nu / s.nn > 0.8 AND s.nu > 20 THEN 'text'
       ELSE 'categorical' END AS semantic_type
FROM ({desc}) d LEFT JOIN ({stats}) s ON s.col = d.col"""


def _sql_unpivot_text(src: str, cols: list[str]) -> str:
    """(col, val) for every non-null cell, booleans as True/False."""
    casts = ", ".join(f"CAST({_q(c)} AS VARCHAR) AS {_q(c)}" for c in cols)
    return (f"(UNPIVOT (SELECT {casts} FROM {src}) ON {', '.join(_q(c) for c in cols)} "
            f"INTO NAME col VALUE val)")


def _sql_positions(cols_all: list[str], chosen: list[str]) -> str:
    rows = ", ".join(f"({i}, '{c}')" for i, c in enumerate(cols_all) if c in chosen)
    return f"(SELECT CAST(p AS INTEGER) AS position, c AS col FROM (VALUES {rows}) t(p, c))"


# column lists of the derived relations (fixed by fixtures.DERIVED)
LI_NULLS_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_NULLS_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
LI_NULLS_STR = ["l_returnflag", "l_linestatus"]
LI_NULLS_NONNUM = ["l_returnflag", "l_linestatus", "l_shipdate"]
LI_NULLS = derived_sql("lineitem_nulls")


# ---------------------------------------------------------------------------
# 2.3 profiling
# ---------------------------------------------------------------------------

_TYPES_TABLES = [
    ("lineitem_nulls", LI_NULLS, LI_NULLS_STR),
    ("customer", "customer", ["c_name", "c_mktsegment"]),
    ("documents", "documents", ["text", "lang", "source"]),
    ("events", "events", ["event_type", "props"]),
]


@register("column_types", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS table_name, * FROM ({_sql_types(src, strs)})" for name, src, strs in _TYPES_TABLES))
def q_column_types(spark, sf):
    out = None
    for name, _, _ in _TYPES_TABLES:
        df = derived(spark, sf, name) if name == "lineitem_nulls" else load(spark, sf, name)
        part = profile.semantic_types(df).select(F.lit(name).alias("table_name"), "position", "column", "semantic_type")
        out = part if out is None else out.unionByName(part)
    return out


@register("null_pct", "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", "
    f"round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) * 100.0, 2) AS null_pct FROM {LI_NULLS}"
    for i, c in enumerate(LI_NULLS_COLS)))
def q_null_pct(spark, sf):
    return profile.null_percentages(derived(spark, sf, "lineitem_nulls"))


@register("duplicate_count", f"""
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {derived_sql('lineitem_proj')})) AS BIGINT) AS n_duplicates,
       round_even((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {derived_sql('lineitem_proj')})))::DOUBLE / count(*) * 100.0, 2) AS pct_duplicates
FROM {derived_sql('lineitem_proj')}""")
def q_duplicate_count(spark, sf):
    return profile.duplicate_count(derived(spark, sf, "lineitem_proj"))


@register("cardinality", f"""
WITH t AS ({_sql_types('customer', ['c_name', 'c_mktsegment'])})
SELECT t.position, t."column", CAST(count(DISTINCT u.val) AS BIGINT) AS n_unique
FROM t JOIN {_sql_unpivot_text('customer', ['c_name', 'c_mktsegment'])} u ON u.col = t."column"
WHERE t.semantic_type IN ('categorical', 'text')
GROUP BY t.position, t."column" """)
def q_cardinality(spark, sf):
    return profile.cardinality(load(spark, sf, "customer"))


def _sql_describe_numeric(src: str, all_cols: list[str], num: list[str]) -> str:
    parts = []
    for c in num:
        i = all_cols.index(c)
        x = f"CAST({_q(c)} AS DOUBLE)"
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", count({x}) AS count, "
            f"round_even(avg({x}), 4) AS mean, round_even(stddev_samp({x}), 4) AS std, "
            f"round_even(min({x}), 4) AS min, round_even(quantile_cont({x}, 0.25), 4) AS q25, "
            f"round_even(quantile_cont({x}, 0.5), 4) AS q50, round_even(quantile_cont({x}, 0.75), 4) AS q75, "
            f"round_even(max({x}), 4) AS max FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("describe_numeric", _sql_describe_numeric(LI_NULLS, LI_NULLS_COLS, LI_NULLS_NUM))
def q_describe_numeric(spark, sf):
    return profile.describe_numeric(derived(spark, sf, "lineitem_nulls"))


def _sql_describe_categorical(src: str, all_cols: list[str], cols: list[str]) -> str:
    return f"""
WITH f AS (SELECT col, val, count(*) AS n FROM {_sql_unpivot_text(src, cols)} GROUP BY col, val),
r AS (SELECT col, count(*) AS n_unique, arg_min(val, (-n, val)) AS top_value, max(n) AS top_freq FROM f GROUP BY col),
tot AS (SELECT count(*) AS n_rows FROM {src})
SELECT p.position, p.col AS "column", CAST(coalesce(r.n_unique, 0) AS BIGINT) AS n_unique, r.top_value,
       CAST(coalesce(r.top_freq, 0) AS BIGINT) AS top_freq,
       CASE WHEN r.top_freq IS NOT NULL AND tot.n_rows > 0
            THEN round_even(r.top_freq::DOUBLE / tot.n_rows * 100.0, 2) ELSE 0.0 END AS pct_top
FROM {_sql_positions(all_cols, cols)} p LEFT JOIN r ON r.col = p.col, tot"""


@register("describe_categorical", _sql_describe_categorical(LI_NULLS, LI_NULLS_COLS, LI_NULLS_NONNUM))
def q_describe_categorical(spark, sf):
    return profile.describe_categorical(derived(spark, sf, "lineitem_nulls"))


def _sql_suggest_target(src: str, all_cols: list[str], strings: list[str]) -> str:
    nulls = " UNION ALL ".join(
        f"SELECT '{c}' AS col, avg(CASE WHEN {_q(c)} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) AS nf FROM {src}"
        for c in all_cols)
    return f"""
WITH t AS ({_sql_types(src, strings)}),
u AS (SELECT col, count(DISTINCT val) AS nu FROM {_sql_unpivot_text(src, all_cols)} GROUP BY col),
nl AS ({nulls}),
c AS (
  SELECT t.position, t."column",
    CASE WHEN coalesce(u.nu, 0) = 2 THEN 0
         WHEN t.semantic_type = 'categorical' AND coalesce(u.nu, 0) BETWEEN 3 AND 10 THEN 1
         WHEN t.semantic_type = 'numeric' AND coalesce(u.nu, 0) BETWEEN 2 AND 10 THEN 2 END AS priority
  FROM t JOIN nl ON nl.col = t."column" LEFT JOIN u ON u.col = t."column"
  WHERE nl.nf * 100.0 / 100.0 <= 0.3)
SELECT CAST(row_number() OVER (ORDER BY priority, position) - 1 AS INTEGER) AS rank, position, "column", priority
FROM c WHERE priority IS NOT NULL"""


@register("suggest_target", _sql_suggest_target(LI_NULLS, LI_NULLS_COLS, LI_NULLS_STR))
def q_suggest_target(spark, sf):
    return profile.suggest_target(derived(spark, sf, "lineitem_nulls"))


def _sql_profile(src: str, all_cols: list[str], num: list[str], nonnum: list[str], strings: list[str]) -> str:
    dup = (f"SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS BIGINT) AS n_duplicates, "
           f"round_even((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})))::DOUBLE / count(*) * 100.0, 2) "
           f"AS pct_duplicates FROM {src}")
    nulls = " UNION ALL ".join(
        f"SELECT '{c}' AS col, round_even(avg(CASE WHEN {_q(c)} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) * 100.0, 2) AS null_pct FROM {src}"
        for c in all_cols)
    return f"""
WITH t AS ({_sql_types(src, strings)}),
u AS (SELECT col, count(DISTINCT val) AS nu FROM {_sql_unpivot_text(src, all_cols)} GROUP BY col),
nl AS ({nulls}),
dn AS ({_sql_describe_numeric(src, all_cols, num)}),
dc AS ({_sql_describe_categorical(src, all_cols, nonnum)}),
st AS ({_sql_suggest_target(src, all_cols, strings)}),
dp AS ({dup})
SELECT t.position, t."column", t.semantic_type, nl.null_pct, CAST(coalesce(u.nu, 0) AS BIGINT) AS n_unique,
       dn.count AS n_numeric, dn.mean, dn.std, dn.min, dn.q25, dn.q50, dn.q75, dn.max,
       dc.top_value, dc.top_freq, dc.pct_top, st.rank AS target_rank, dp.n_duplicates, dp.pct_duplicates
FROM t JOIN nl ON nl.col = t."column" LEFT JOIN u ON u.col = t."column"
LEFT JOIN dn ON dn."column" = t."column" LEFT JOIN dc ON dc."column" = t."column"
LEFT JOIN st ON st."column" = t."column", dp"""


@register("profile", _sql_profile(LI_NULLS, LI_NULLS_COLS, LI_NULLS_NUM, LI_NULLS_NONNUM, LI_NULLS_STR))
def q_profile(spark, sf):
    return profile.profile(derived(spark, sf, "lineitem_nulls"))


# ---------------------------------------------------------------------------
# 2.4 cleaning
# ---------------------------------------------------------------------------

def _sql_outlier_summary(table: str, cols: list[str]) -> str:
    casts = ", ".join(f"CAST({_q(c)} AS DOUBLE) AS {_q(c)}" for c in cols)
    return f"""
WITH l AS (UNPIVOT (SELECT {casts} FROM {table}) ON {', '.join(_q(c) for c in cols)} INTO NAME col VALUE x),
f AS (SELECT col, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY col),
n AS (SELECT count(*) AS n FROM {table})
SELECT '{table}' AS table_name, l.col AS "column",
  CAST(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers,
  round_even(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::DOUBLE / max(n.n) * 100.0, 2) AS pct_outliers
FROM l JOIN f ON f.col = l.col, n GROUP BY l.col"""


_OUTLIER_TABLES = [("events", ["event_id", "user_id", "value"]), ("documents", ["doc_id", "n_chars"])]


@register("outlier_summary", "\nUNION ALL\n".join(f"SELECT * FROM ({_sql_outlier_summary(t, c)})" for t, c in _OUTLIER_TABLES))
def q_outlier_summary(spark, sf):
    out = None
    for t, _ in _OUTLIER_TABLES:
        part = clean.outlier_summary(load(spark, sf, t)).select(F.lit(t).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


SHOW_DIGITS = 6


def _show(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values that come from a floating mean or deviation depend on the
    summation order (partitioning) in their last bits; the query shows them
    with 6 decimals (both sides).  The library returns full precision."""
    return df.select(*[F.bround(c, SHOW_DIGITS).alias(c) if c in cols else F.col(c) for c in df.columns])


def _mean_fill(c: str) -> str:
    return f"coalesce({c}, (SELECT avg({c}) FROM {LI_NULLS}))"


@register("impute_mean", f"""
SELECT l_orderkey, l_linenumber, round_even({_mean_fill('l_quantity')}, 6) AS l_quantity,
       round_even({_mean_fill('l_tax')}, 6) AS l_tax
FROM {LI_NULLS}""")
def q_impute_mean(spark, sf):
    df = derived(spark, sf, "lineitem_nulls").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = clean.handle_missing(df, {"l_quantity": "mean", "l_tax": "mean"})
    return _show(out, ["l_quantity", "l_tax"])


@register("impute_median", f"""
SELECT l_orderkey, l_linenumber,
  coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {LI_NULLS})) AS l_quantity,
  coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM {LI_NULLS})) AS l_extendedprice,
  coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM {LI_NULLS})) AS l_tax
FROM {LI_NULLS}""")
def q_impute_median(spark, sf):
    df = derived(spark, sf, "lineitem_nulls").select("l_orderkey", "l_linenumber", "l_quantity",
                                                     "l_extendedprice", "l_tax")
    return clean.handle_missing(df, {"l_quantity": "median", "l_extendedprice": "median", "l_tax": "median"})


@register("impute_mode", f"""
SELECT l_orderkey, l_linenumber,
  coalesce(l_returnflag, (SELECT arg_min(l_returnflag, (-n, l_returnflag)) FROM
     (SELECT l_returnflag, count(*) AS n FROM {LI_NULLS} WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag))) AS l_returnflag,
  coalesce(l_quantity, (SELECT arg_min(l_quantity, (-n, l_quantity)) FROM
     (SELECT l_quantity, count(*) AS n FROM {LI_NULLS} WHERE l_quantity IS NOT NULL GROUP BY l_quantity))) AS l_quantity
FROM {LI_NULLS}""")
def q_impute_mode(spark, sf):
    df = derived(spark, sf, "lineitem_nulls").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return clean.handle_missing(df, {"l_returnflag": "mode", "l_quantity": "mode"})


@register("impute_drop", f"""
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag,
  round_even(coalesce(l_extendedprice, (SELECT avg(l_extendedprice) FROM {LI_NULLS})), 6) AS l_extendedprice
FROM {LI_NULLS} WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL""")
def q_impute_drop(spark, sf):
    df = derived(spark, sf, "lineitem_nulls").select("l_orderkey", "l_linenumber", "l_quantity",
                                                     "l_returnflag", "l_extendedprice")
    out = clean.handle_missing(df, {"l_quantity": "drop", "l_returnflag": "drop", "l_extendedprice": "mean",
                                    "no_such_column": "mean"})
    return _show(out, ["l_extendedprice"])


@register("impute_constant", f"""
SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0.0) AS l_quantity,
       coalesce(l_returnflag, 'missing') AS l_returnflag
FROM {LI_NULLS}""")
def q_impute_constant(spark, sf):
    df = derived(spark, sf, "lineitem_nulls").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return clean.handle_missing(df, {"l_quantity": 0.0, "l_returnflag": "missing"})


@register("dedup", f"SELECT DISTINCT * FROM {derived_sql('lineitem_proj')}")
def q_dedup(spark, sf):
    return clean.remove_duplicates(derived(spark, sf, "lineitem_proj"))


EV_NUM = ["event_id", "user_id", "value"]
_EV_IQR_FLAG = " OR ".join(f"(CAST({c} AS DOUBLE) < lo_{c} OR CAST({c} AS DOUBLE) > hi_{c})" for c in EV_NUM)
_EV_Z_FLAG = " OR ".join(f"coalesce(sd_{c} > 0 AND abs((CAST({c} AS DOUBLE) - m_{c}) / sd_{c}) > 3.0, false)" for c in EV_NUM)
_EV_MOMENTS = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}, "
                        f"stddev_samp(CAST({c} AS DOUBLE)) AS ss_{c}" for c in EV_NUM)
_EV_FENCES = "(SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) - 1.5 * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS lo_{c}, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) + 1.5 * (quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS hi_{c}"
    for c in EV_NUM) + " FROM events)"


@register("outliers_iqr", f"SELECT e.* FROM events e, {_EV_FENCES} f WHERE {_EV_IQR_FLAG}")
def q_outliers_iqr(spark, sf):
    return clean.detect_outliers(load(spark, sf, "events"), "iqr")


@register("outliers_zscore", f"SELECT e.* FROM events e, (SELECT {_EV_MOMENTS} FROM events) m WHERE {_EV_Z_FLAG}")
def q_outliers_zscore(spark, sf):
    return clean.detect_outliers(load(spark, sf, "events"), "zscore")


@register("outliers_remove", f"""
SELECT d.* FROM documents d,
  (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3 FROM documents) f
WHERE NOT (CAST(n_chars AS DOUBLE) < q1 - 1.5 * (q3 - q1) OR CAST(n_chars AS DOUBLE) > q3 + 1.5 * (q3 - q1))""")
def q_outliers_remove(spark, sf):
    return clean.handle_outliers(load(spark, sf, "documents"), "iqr", "remove", columns=["n_chars", "text"])


@register("outliers_cap_iqr", f"""
SELECT e.event_id, e.ts, e.user_id, e.event_type,
  CASE WHEN e.value IS NULL THEN NULL ELSE least(greatest(e.value, f.lo), f.hi) END AS value, e.props
FROM events e,
  (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
          quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events) f""")
def q_outliers_cap_iqr(spark, sf):
    return clean.handle_outliers(load(spark, sf, "events"), "iqr", "cap", columns=["value"])


@register("outliers_cap_z", f"""
SELECT d.doc_id, d.lang,
  round_even(CASE WHEN d.n_chars IS NULL THEN NULL
       ELSE least(greatest(CAST(d.n_chars AS DOUBLE), m.m - 3.0 * m.s), m.m + 3.0 * m.s) END, 6) AS n_chars
FROM documents d, (SELECT avg(CAST(n_chars AS DOUBLE)) AS m, stddev_samp(CAST(n_chars AS DOUBLE)) AS s FROM documents) m""")
def q_outliers_cap_z(spark, sf):
    df = load(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return _show(clean.handle_outliers(df, "zscore", "cap", columns=["n_chars"]), ["n_chars"])


# ---------------------------------------------------------------------------
# 2.2 / 2.5 projection, encoding, split, scaling
# ---------------------------------------------------------------------------

from tessera.operators import prep  # noqa: E402

LI_MODEL = derived_sql("lineitem_model")
MODEL_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("features_target", f"SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_revenue, big_order FROM {LI_MODEL}")
def q_features_target(spark, sf):
    return prep.prepare_features_target(derived(spark, sf, "lineitem_model"), "big_order",
                                        MODEL_FEATURES + ["l_revenue"])


#: Levels of the provided tables: a view needs the columns of a pivot by name.
LEVELS = {"o_orderstatus": ["F", "O", "P"],
          "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
          "p_type": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]}


def _sql_onehot(table: str, key: str, col: str) -> str:
    names = ", ".join(f"'{col}_{v}'" for v in LEVELS[col])
    return (f"(PIVOT (SELECT {key}, '{col}_' || {col} AS lvl FROM {table} WHERE {col} IS NOT NULL) "
            f"ON lvl IN ({names}) USING count(*) GROUP BY {key})")


@register("encode_onehot", f"""
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate,
       a.* EXCLUDE (o_orderkey), b.* EXCLUDE (o_orderkey)
FROM orders o JOIN {_sql_onehot('orders', 'o_orderkey', 'o_orderstatus')} a USING (o_orderkey)
JOIN {_sql_onehot('orders', 'o_orderkey', 'o_orderpriority')} b USING (o_orderkey)""")
def q_encode_onehot(spark, sf):
    out, _ = prep.encode_categoricals(load(spark, sf, "orders"), method="onehot")
    return out


@register("encode_label", """
SELECT p_partkey,
  dense_rank() OVER (ORDER BY coalesce(p_name, 'nan')) - 1 AS p_name,
  dense_rank() OVER (ORDER BY coalesce(p_brand, 'nan')) - 1 AS p_brand,
  dense_rank() OVER (ORDER BY coalesce(p_type, 'nan')) - 1 AS p_type,
  p_size, p_retailprice
FROM part""")
def q_encode_label(spark, sf):
    out, _ = prep.encode_categoricals(load(spark, sf, "part"), method="label")
    return out


@register("encode_auto", f"""
WITH t AS {_sql_onehot('part', 'p_partkey', 'p_type')}
SELECT p.p_partkey,
  dense_rank() OVER (ORDER BY coalesce(p.p_name, 'nan')) - 1 AS p_name,
  dense_rank() OVER (ORDER BY coalesce(p.p_brand, 'nan')) - 1 AS p_brand,
  p.p_size, p.p_retailprice, t.* EXCLUDE (p_partkey)
FROM part p JOIN t USING (p_partkey)""")
def q_encode_auto(spark, sf):
    out, _ = prep.encode_categoricals(load(spark, sf, "part"), method="auto", low_card_threshold=10)
    return out


def _sql_split(src: str, key_sql: str, y_sql: str | None, val: float = 0.15, test: float = 0.15, seed: int = 42) -> str:
    held = val + test
    rel = test / held
    g = y_sql if y_sql else "0"
    return f"""
WITH b AS (SELECT *, {g} AS __g, {key_sql} AS __k,
                  ('0x' || substr(md5('{seed}|' || {key_sql}), 1, 15))::BIGINT AS __h FROM {src}),
r AS (SELECT *, row_number() OVER (PARTITION BY __g ORDER BY __h, __k) - 1 AS __rk FROM b),
cls AS (SELECT __g, count(*) AS n_c FROM b GROUP BY __g),
tot AS (SELECT sum(n_c) AS n, CAST(ceil(CAST({held!r} AS DOUBLE) * sum(n_c)) AS BIGINT) AS held FROM cls),
a1 AS (SELECT __g, n_c, (held * n_c) // n AS base, (held * n_c) % n AS rem, held FROM cls, tot),
h1 AS (SELECT __g, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, __g) <= held - sum(base) OVER () THEN 1 ELSE 0 END AS held_c FROM a1),
tot2 AS (SELECT sum(held_c) AS m, CAST(ceil(CAST({rel!r} AS DOUBLE) * sum(held_c)) AS BIGINT) AS ntest FROM h1),
a2 AS (SELECT __g, held_c, (ntest * held_c) // m AS base, (ntest * held_c) % m AS rem, ntest FROM h1, tot2),
q AS (SELECT __g, held_c, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, __g) <= ntest - sum(base) OVER () THEN 1 ELSE 0 END AS test_c FROM a2)
SELECT r.* EXCLUDE (__g, __k, __h, __rk),
       CASE WHEN __rk < test_c THEN 'test' WHEN __rk < held_c THEN 'val' ELSE 'train' END AS split
FROM r JOIN q ON q.__g IS NOT DISTINCT FROM r.__g"""


@register("split_stratified", _sql_split("(SELECT o_orderkey, o_orderstatus FROM orders)",
                                         "CAST(o_orderkey AS VARCHAR)", "o_orderstatus"))
def q_split_stratified(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return prep.split_data(df, "o_orderstatus", ["o_orderkey"], stratify=True, seed=42)


@register("split_random", _sql_split("(SELECT o_orderkey, o_orderstatus FROM orders)",
                                     "CAST(o_orderkey AS VARCHAR)", None))
def q_split_random(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return prep.split_data(df, "o_orderstatus", ["o_orderkey"], stratify=False, seed=42)


LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # unique row key
_LI_KEY_SQL = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in LI_KEY) + ")"
_LI_SPLIT_SQL = _sql_split(f"(SELECT {', '.join(LI_KEY)}, {', '.join(MODEL_FEATURES)}, big_order FROM {LI_MODEL})",
                           _LI_KEY_SQL, "big_order")


# a split's cuts are found once for the queries of one session and data folder
_SPLITS: dict = {}


def lineitem_split(spark, sf) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SPLITS:
        df = derived(spark, sf, "lineitem_model").select(*LI_KEY, *MODEL_FEATURES, "big_order")
        _SPLITS[key] = prep.split_data(df, "big_order", LI_KEY, stratify=True, seed=42)
    return _SPLITS[key]


def _rnd(e: str, method: str) -> str:
    d = _SCALE_DIGITS.get(method)
    return f"round_even({e}, {d})" if d is not None else e


def _sql_scaled(method: str) -> str:
    if method == "standard":
        stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS a_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS b_{c}" for c in MODEL_FEATURES)
        expr = {c: f"(CAST(s.{c} AS DOUBLE) - p.a_{c}) / CASE WHEN p.b_{c} IS NULL OR p.b_{c} = 0 THEN 1.0 ELSE p.b_{c} END"
                for c in MODEL_FEATURES}
    elif method == "minmax":
        stats = ", ".join(f"min(CAST({c} AS DOUBLE)) AS a_{c}, max(CAST({c} AS DOUBLE)) AS b_{c}" for c in MODEL_FEATURES)
        expr = {c: f"(CAST(s.{c} AS DOUBLE) - p.a_{c}) / CASE WHEN p.b_{c} - p.a_{c} = 0 THEN 1.0 ELSE p.b_{c} - p.a_{c} END"
                for c in MODEL_FEATURES}
    else:
        stats = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS a_{c}, "
                          f"quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) AS b_{c}"
                          for c in MODEL_FEATURES)
        expr = {c: f"(CAST(s.{c} AS DOUBLE) - p.a_{c}) / CASE WHEN p.b_{c} = 0 THEN 1.0 ELSE p.b_{c} END"
                for c in MODEL_FEATURES}
    return f"""
WITH s AS ({_LI_SPLIT_SQL}),
p AS (SELECT {stats} FROM s WHERE split = 'train')
SELECT {', '.join('s.' + k for k in LI_KEY)}, {', '.join(f'{_rnd(e, method)} AS {c}' for c, e in expr.items())}, s.big_order, s.split
FROM s, p"""


# standard scaling divides by a mean and deviation whose last bits depend on
# summation order, so that query (both sides) shows 9 decimals
_SCALE_DIGITS = {"standard": 6}


def _scaled(method):
    def run(spark, sf):
        out, _ = prep.scale_features(lineitem_split(spark, sf), method, columns=MODEL_FEATURES)
        d = _SCALE_DIGITS.get(method)
        if d is not None:
            out = out.select(*[F.bround(c, d).alias(c) if c in MODEL_FEATURES else F.col(c) for c in out.columns])
        return out
    return run


for _m in prep.SCALERS:
    register(f"scale_{_m}", _sql_scaled(_m))(_scaled(_m))


# ---------------------------------------------------------------------------
# 2.8 evaluation (model-free: computed scores on the labels table)
# ---------------------------------------------------------------------------

from tessera.operators import evaluate  # noqa: E402

LBL_SCORED = derived_sql("labels_scored")
LBL_MULTI = derived_sql("labels_multi")


def _sql_metrics(src: str, y: str, p: str, average: str, pos=None) -> str:
    if average == "binary":
        final = ("max(prec) FILTER (WHERE c = {pos}) AS precision, max(rec) FILTER (WHERE c = {pos}) AS recall, "
                 "max(f1) FILTER (WHERE c = {pos}) AS f1").format(pos=pos)
    elif average == "weighted":
        final = ("CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(prec * support::DOUBLE) / sum(support::DOUBLE) END AS precision, "
                 "CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(rec * support::DOUBLE) / sum(support::DOUBLE) END AS recall, "
                 "CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(f1 * support::DOUBLE) / sum(support::DOUBLE) END AS f1")
    else:
        final = "avg(prec) AS precision, avg(rec) AS recall, avg(f1) AS f1"
    return f"""
WITH cnt AS (SELECT {y} AS y, {p} AS p, count(*) AS n FROM {src} GROUP BY ALL),
cls AS (SELECT y AS c FROM cnt UNION SELECT p FROM cnt),
pc AS (SELECT c,
   coalesce((SELECT sum(n) FROM cnt WHERE cnt.y = cls.c AND cnt.p = cls.c), 0) AS tp,
   coalesce((SELECT sum(n) FROM cnt WHERE cnt.y = cls.c), 0) AS support,
   coalesce((SELECT sum(n) FROM cnt WHERE cnt.p = cls.c), 0) AS predicted FROM cls WHERE c IS NOT NULL),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted::DOUBLE END AS prec,
                CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support::DOUBLE END AS rec FROM pc),
f AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2.0 * prec * rec / (prec + rec) END AS f1 FROM m),
a AS (SELECT CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(tp)::DOUBLE / sum(support)::DOUBLE END AS accuracy, {final} FROM f)
SELECT round_even(accuracy, 4) AS accuracy, round_even(coalesce(f1, 0.0), 4) AS f1,
       round_even(coalesce(precision, 0.0), 4) AS precision, round_even(coalesce(recall, 0.0), 4) AS recall FROM a"""


@register("metrics_weighted", _sql_metrics(LBL_MULTI, "label", "prediction", "weighted"))
def q_metrics_weighted(spark, sf):
    return evaluate.classification_metrics(derived(spark, sf, "labels_multi"), "label", "prediction", "weighted")


@register("metrics_macro", _sql_metrics(LBL_MULTI, "label", "prediction", "macro"))
def q_metrics_macro(spark, sf):
    return evaluate.classification_metrics(derived(spark, sf, "labels_multi"), "label", "prediction", "macro")


@register("metrics_binary", _sql_metrics(LBL_SCORED, "toxic", "prediction", "binary", pos=1))
def q_metrics_binary(spark, sf):
    return evaluate.classification_metrics(derived(spark, sf, "labels_scored"), "toxic", "prediction", "binary")


def _sql_auc(src: str, y: str, score: str, pos: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""
WITH s AS (SELECT {g}CAST({score} AS DOUBLE) AS score, sum(CASE WHEN {y} = {pos} THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN {y} = {pos} THEN 0 ELSE 1 END) AS neg
           FROM {src} WHERE {score} IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER ({part}ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM s)
SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round_even(sum(pos::DOUBLE * ((cum_neg - neg)::DOUBLE + 0.5 * neg::DOUBLE))
       / (sum(pos) * sum(neg))::DOUBLE, 4) END AS auc
FROM c GROUP BY ALL"""


@register("auc_binary", _sql_auc(LBL_SCORED, "toxic", "score", "1"))
def q_auc_binary(spark, sf):
    return evaluate.auc_binary(derived(spark, sf, "labels_scored"), "toxic", "score")


@register("auc_ovr", f"""
WITH l AS (SELECT label, 0 AS cls, p0 AS score FROM {LBL_MULTI} UNION ALL
           SELECT label, 1, p1 FROM {LBL_MULTI} UNION ALL SELECT label, 2, p2 FROM {LBL_MULTI}),
s AS (SELECT cls, score, sum(CASE WHEN label = cls THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN label = cls THEN 0 ELSE 1 END) AS neg FROM l GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM s),
a AS (SELECT cls, sum(pos::DOUBLE * ((cum_neg - neg)::DOUBLE + 0.5 * neg::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE AS auc,
             sum(pos) AS p FROM c GROUP BY cls)
SELECT round_even(sum(auc * p::DOUBLE) / sum(p)::DOUBLE, 4) AS auc FROM a""")
def q_auc_ovr(spark, sf):
    return evaluate.auc_ovr(derived(spark, sf, "labels_multi"), "label", ["p0", "p1", "p2"])


@register("confusion_matrix", f"""
WITH d AS (SELECT label AS t, prediction AS p FROM {LBL_MULTI}),
cls AS (SELECT DISTINCT t AS c FROM d WHERE t IS NOT NULL),
cnt AS (SELECT t, p, count(*) AS n FROM d GROUP BY ALL)
SELECT a.c AS "true", b.c AS predicted, CAST(coalesce(cnt.n, 0) AS BIGINT) AS count
FROM cls a JOIN cls b ON true LEFT JOIN cnt ON cnt.t = a.c AND cnt.p = b.c""")
def q_confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(derived(spark, sf, "labels_multi"), "label", "prediction")


@register("confusion_binary", f"""
WITH a AS (SELECT count(*) FILTER (WHERE toxic = 1 AND prediction = 1) AS TP,
                  count(*) FILTER (WHERE toxic = 0 AND prediction = 0) AS TN,
                  count(*) FILTER (WHERE toxic = 0 AND prediction = 1) AS FP,
                  count(*) FILTER (WHERE toxic = 1 AND prediction = 0) AS FN FROM {LBL_SCORED})
SELECT TP, TN, FP, FN,
  round_even(CASE WHEN TP + FN = 0 THEN 0.0 ELSE TP::DOUBLE / (TP + FN)::DOUBLE END, 4) AS sensitivity,
  round_even(CASE WHEN TN + FP = 0 THEN 0.0 ELSE TN::DOUBLE / (TN + FP)::DOUBLE END, 4) AS specificity,
  round_even(CASE WHEN TP + FP = 0 THEN 0.0 ELSE TP::DOUBLE / (TP + FP)::DOUBLE END, 4) AS ppv FROM a""")
def q_confusion_binary(spark, sf):
    return evaluate.confusion_binary(derived(spark, sf, "labels_scored"), "toxic", "prediction")


def _sql_roc(src: str, y: str, score: str, pos: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    on = f"USING ({group})" if group else "ON true"
    return f"""
WITH s AS (SELECT {g}CAST({score} AS DOUBLE) AS score, sum(CASE WHEN {y} = {pos} THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN {y} = {pos} THEN 0 ELSE 1 END) AS neg FROM {src} WHERE {score} IS NOT NULL GROUP BY ALL),
t AS (SELECT {g}sum(pos) AS P, sum(neg) AS N, count(*) AS D FROM s GROUP BY ALL),
c AS (SELECT {g}score, sum(pos) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
             sum(neg) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
             row_number() OVER ({part}ORDER BY score DESC) - 1 AS i FROM s),
k AS (SELECT *, lag(tps) OVER ({part}ORDER BY i) AS tp_prev, lead(tps) OVER ({part}ORDER BY i) AS tp_next,
                lag(fps) OVER ({part}ORDER BY i) AS fp_prev, lead(fps) OVER ({part}ORDER BY i) AS fp_next FROM c)
SELECT {g}'inf'::DOUBLE AS threshold, CASE WHEN N > 0 THEN 0.0::DOUBLE END AS fpr,
       CASE WHEN P > 0 THEN 0.0::DOUBLE END AS tpr FROM t
UNION ALL
SELECT {g}score AS threshold, CASE WHEN N > 0 THEN fps::DOUBLE / N::DOUBLE END AS fpr,
       CASE WHEN P > 0 THEN tps::DOUBLE / P::DOUBLE END AS tpr
FROM k JOIN t {on}
WHERE D <= 2 OR i = 0 OR i = D - 1 OR fp_next - 2 * fps + fp_prev <> 0 OR tp_next - 2 * tps + tp_prev <> 0"""


def _sql_roc_auc(src: str, y: str, score: str, pos: str, group: str | None = None) -> str:
    """The points with the AUC beside them."""
    on, g = (f"USING ({group})", f"r.{group}, ") if group else ("ON true", "")
    return (f"WITH r AS ({_sql_roc(src, y, score, pos, group)}), a AS ({_sql_auc(src, y, score, pos, group)}) "
            f"SELECT {g}r.threshold, r.fpr, r.tpr, a.auc FROM r JOIN a {on}")


@register("roc_curve", _sql_roc_auc(LBL_SCORED, "toxic", "score", "1"))
def q_roc_curve(spark, sf):
    return evaluate.roc_curve(derived(spark, sf, "labels_scored"), "toxic", "score")


_LI_MODEL = derived_sql("lineitem_model")


@register("roc_lineitem", _sql_roc_auc(_LI_MODEL, "big_order", "l_revenue", "1"))
def q_roc_lineitem(spark, sf):
    """About as many distinct scores as rows: revenue as the score of a large order."""
    return evaluate.roc_curve(derived(spark, sf, "lineitem_model"), "big_order", "l_revenue")


_ROC_STACK = (f"(SELECT 'score' AS model, toxic, score FROM {LBL_SCORED} UNION ALL "
              f"SELECT 'quality' AS model, toxic, CAST(1 - quality AS DOUBLE) + CAST(doc_id % 3 AS DOUBLE) / 10.0 AS score "
              f"FROM {LBL_SCORED})")


def _roc_stack(spark, sf) -> DataFrame:
    d = derived(spark, sf, "labels_scored")
    a = d.select(F.lit("score").alias("model"), "toxic", "score")
    b = d.selectExpr("'quality' AS model", "toxic",
                     "CAST(1 - quality AS DOUBLE) + CAST(doc_id % 3 AS DOUBLE) / 10.0 AS score")
    return a.unionByName(b)


@register("roc_multi", _sql_roc_auc(_ROC_STACK, "toxic", "score", "1", "model"))
def q_roc_multi(spark, sf):
    return evaluate.roc_curve(_roc_stack(spark, sf), "toxic", "score", group_cols=["model"], pos_label=1)


# ---------------------------------------------------------------------------
# 2.7 classification
# ---------------------------------------------------------------------------

from tessera.functions.types import spread  # noqa: E402
from tessera.operators import classify  # noqa: E402
from tessera.session import shared_dir  # noqa: E402

_LBL_SPLIT_SQL = _sql_split("(SELECT doc_id, quality, toxic FROM labels)", "CAST(doc_id AS VARCHAR)", "toxic")
_U_SQL = "('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT::DOUBLE / 4294967296.0"


def labels_split(spark, sf) -> DataFrame:
    df = load(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return prep.split_data(df, "toxic", ["doc_id"], stratify=True, seed=42)


def _baseline(strategy):
    def run(spark, sf):
        s = labels_split(spark, sf)
        m = classify.train_baseline(s.where(F.col("split") == "train"), "toxic", strategy, seed=42)
        return m.transform(s, ["doc_id"]).select("doc_id", "toxic", "split", "prediction")
    return run


register("baseline_majority", f"""
WITH s AS ({_LBL_SPLIT_SQL}),
m AS (SELECT toxic AS c FROM s WHERE split = 'train' GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1)
SELECT s.doc_id, s.toxic, s.split, m.c AS prediction FROM s, m""")(_baseline("most_frequent"))

register("baseline_stratified", f"""
WITH s AS ({_LBL_SPLIT_SQL}),
c AS (SELECT toxic AS c, count(*) AS n FROM s WHERE split = 'train' GROUP BY toxic),
cp AS (SELECT c, (sum(n) OVER (ORDER BY c ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(n) OVER ())::DOUBLE AS edge,
              row_number() OVER (ORDER BY c DESC) = 1 AS is_last FROM c),
u AS (SELECT *, {_U_SQL} AS u FROM s)
SELECT u.doc_id, u.toxic, u.split,
       (SELECT min(c) FROM cp WHERE u.u < cp.edge OR cp.is_last) AS prediction FROM u""")(_baseline("stratified"))

register("baseline_uniform", f"""
WITH s AS ({_LBL_SPLIT_SQL}),
c AS (SELECT toxic AS c, row_number() OVER (ORDER BY toxic) - 1 AS i, count(*) OVER () AS k
      FROM (SELECT DISTINCT toxic FROM s WHERE split = 'train')),
u AS (SELECT *, {_U_SQL} AS u FROM s)
SELECT u.doc_id, u.toxic, u.split,
       (SELECT c FROM c WHERE c.i = floor(u.u * c.k::DOUBLE)) AS prediction FROM u""")(_baseline("uniform"))


@register("class_weights", """
SELECT doc_id, toxic,
       (count(*) OVER ())::DOUBLE / ((SELECT count(DISTINCT toxic) FROM labels) * count(*) OVER (PARTITION BY toxic))::DOUBLE AS weight
FROM labels""")
def q_class_weights(spark, sf):
    return classify.class_weights(load(spark, sf, "labels").select("doc_id", "toxic"), "toxic")


# fitted models are shared by the queries of one session and data folder
_MODELS: dict = {}


def _model(spark, sf, kind: str):
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _MODELS:
        train = lineitem_split(spark, sf).where(F.col("split") == "train")
        if kind == "tree":
            _MODELS[key] = classify.train_decision_tree(train, MODEL_FEATURES, "big_order", max_depth=5)
        else:
            _MODELS[key] = classify.train_random_forest(train, MODEL_FEATURES, "big_order", n_estimators=100)
    return _MODELS[key]


@register("decision_tree")
def q_decision_tree(spark, sf):
    s = lineitem_split(spark, sf)
    return _model(spark, sf, "tree").predict(s.where(F.col("split") == "test")) \
        .select(*LI_KEY, "big_order", "prediction")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows that a forest scores: a walk through each tree a row, far more than reading it."""
    return spread(df, df.count())


@register("random_forest")
def q_random_forest(spark, sf):
    s = lineitem_split(spark, sf)
    return _model(spark, sf, "forest").predict(_dealt(s.where(F.col("split") == "test"))) \
        .select(*LI_KEY, "big_order", "prediction", "probability")


@register("predict")
def q_predict(spark, sf):
    s = lineitem_split(spark, sf)
    return _model(spark, sf, "tree").predict(s).select(*LI_KEY, "split", "prediction")


@register("predict_proba")
def q_predict_proba(spark, sf):
    s = lineitem_split(spark, sf)
    m = _model(spark, sf, "forest")
    out = classify.probability_frame(m.predict(_dealt(s.where(F.col("split") == "test"))), m.classes)
    return out.select(*LI_KEY, *[f"p_{c}" for c in m.classes])


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    m = _model(spark, sf, "tree")
    path = shared_dir(spark, "model")
    m.save(path)
    again = classify.load_classifier(path, m.classes, m.features, m.label_col)
    s = lineitem_split(spark, sf)
    a = m.predict(s).select(*LI_KEY, F.col("prediction").alias("prediction"))
    b = again.predict(s).select(*LI_KEY, F.col("prediction").alias("reloaded"))
    return a.join(b, LI_KEY).withColumn("same", F.col("prediction") == F.col("reloaded"))


@register("score_batch")
def q_score_batch(spark, sf):
    """Score every lineitem row with a saved, reloaded forest pipeline."""
    m = _model(spark, sf, "forest")
    path = shared_dir(spark, "forest")
    m.save(path)
    loaded = classify.load_classifier(path, m.classes, m.features, m.label_col)
    rows = derived(spark, sf, "lineitem_model").select(*LI_KEY, *MODEL_FEATURES)
    return loaded.predict(_dealt(rows)).select(*LI_KEY, "prediction", "probability")


_ORDER_RAW = ["o_orderstatus", "o_orderpriority", "o_totalprice"]


@register("score_records", "SELECT o_orderkey, true AS same FROM orders")
def q_score_records(spark, sf):
    """Every order as a raw record, scored by a saved and reloaded model that encodes and scales
    by itself: the prediction is that of the model on rows encoded and scaled before."""
    orders = load(spark, sf, "orders").select("o_orderkey", *_ORDER_RAW, (F.col("o_custkey") % 2).cast("int").alias("label"))
    encoder = prep.fit_encoder(orders, "auto", exclude_cols=["label"])
    coded = encoder.transform(orders)
    scaler = prep.fit_scaler(coded, "robust", ["o_totalprice"])
    ready = scaler.transform(coded)
    features = [c for c in ready.columns if c not in ("o_orderkey", "label")]
    model = classify.train_decision_tree(ready, features, "label", max_depth=4)
    path = shared_dir(spark, "raw-model")
    classify.with_preparation(model, encoder, scaler, _ORDER_RAW).save(path)
    again = classify.load_classifier(path, model.classes, model.features, "label", _ORDER_RAW)
    a = model.predict(ready).select("o_orderkey", "prediction", "probability")
    b = again.predict(orders.select("o_orderkey", *_ORDER_RAW)).select("o_orderkey", F.col("prediction").alias("p"), F.col("probability").alias("q"))
    return a.join(b, "o_orderkey").select("o_orderkey", ((F.col("prediction") == F.col("p")) & (F.col("probability") == F.col("q"))).alias("same"))


@register("feature_importance")
def q_feature_importance(spark, sf, top_n: int = 20):
    m = _model(spark, sf, "forest")
    imp = spark.createDataFrame(m.feature_importances(), "feature string, importance double")
    return imp.orderBy(F.col("importance").desc(), "feature").limit(top_n)


@register("tree_nodes")
def q_tree_nodes(spark, sf):
    m = _model(spark, sf, "tree")
    path = shared_dir(spark, "tree")
    m.estimator.write().overwrite().save(path)
    return classify.tree_nodes(spark, path, m.features, max_depth=3)


# ---------------------------------------------------------------------------
# 2.6 segmentation
# ---------------------------------------------------------------------------

from tessera.operators import segment  # noqa: E402
from tessera.plans import segmentation  # noqa: E402

_SEGS: dict = {}


def _customer_features(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "features")
    if key not in _SEGS:
        _SEGS[key] = segmentation.scaled_features(spark, sf)
    return _SEGS[key]


def _customer_kmeans(spark, sf, k: int = 4):
    key = (spark.sparkContext.applicationId, sf, k)
    if key not in _SEGS:
        feats = _customer_features(spark, sf)
        _SEGS[key] = (feats, segment.run_kmeans(feats, k, 42))
    return _SEGS[key]


@register("kmeans")
def q_kmeans(spark, sf):
    feats, res = _customer_kmeans(spark, sf)
    return res.assign(feats).select("c_custkey", "cluster", F.lit(res.inertia).alias("inertia"))


@register("kmeans_sweep")
def q_kmeans_sweep(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "sweep")
    if key not in _SEGS:  # shared with best_k
        feats = _customer_features(spark, sf)
        _SEGS[key] = segment.find_optimal_k(feats, 2, 10, 42)
    return _SEGS[key]


@register("best_k")
def q_best_k(spark, sf):
    return segment.best_k(q_kmeans_sweep(spark, sf))


@register("bisecting")
def q_bisecting(spark, sf):
    feats = _customer_features(spark, sf)
    return segment.run_bisecting(feats, 4).select("c_custkey", "cluster")


@register("dendrogram")
def q_dendrogram(spark, sf):
    """The tree of bisecting k-means over all customers, 30 leaves."""
    return segment.bisecting_tree(_customer_features(spark, sf), 30)


@register("pca_2d")
def q_pca_2d(spark, sf):
    feats, res = _customer_kmeans(spark, sf)
    return segment.pca_2d(res.assign(feats), ["c_custkey", "cluster"])


_SIL_SQL = """
WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(list_distance(a.e, b.e)) AS s, count(*) AS n
      FROM p a, p b GROUP BY ALL),
per AS (SELECT vec_id, own, max(CASE WHEN c = own THEN s END) AS s_own, max(CASE WHEN c = own THEN n END) AS n_own,
               min(CASE WHEN c <> own THEN s / n END) AS b FROM s GROUP BY vec_id, own),
v AS (SELECT vec_id AS id, CAST(own AS BIGINT) AS cluster,
        CASE WHEN n_own <= 1 OR b IS NULL OR greatest(s_own, b) = 0 THEN 0.0
             ELSE (b - s_own / (n_own - 1)) / greatest(s_own / (n_own - 1), b) END AS silhouette FROM per)"""


def _embedding_sil(spark, sf):
    return segment.euclidean_silhouette_samples(load(spark, sf, "embeddings"), "embedding", "label", id_col="vec_id")


@register("silhouette_samples", _SIL_SQL + "\nSELECT id, cluster, round_even(silhouette, 9) AS silhouette FROM v")
def q_silhouette_samples(spark, sf):
    return _embedding_sil(spark, sf).select("id", "cluster", F.bround("silhouette", 9).alias("silhouette"))


@register("silhouette", _SIL_SQL + "\nSELECT round_even(avg(silhouette), 9) AS silhouette, count(*) AS n FROM v")
def q_silhouette(spark, sf):
    return _embedding_sil(spark, sf).agg(F.bround(F.avg("silhouette"), 9).alias("silhouette"),
                                         F.count(F.lit(1)).alias("n"))


_PROFILE_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PROFILE_SQL = ("SELECT l_linenumber AS cluster, "
                + ", ".join(f"round_even(avg(CAST({f} AS DOUBLE)), 4) AS {f}_mean, "
                            f"round_even(stddev_samp(CAST({f} AS DOUBLE)), 4) AS {f}_std" for f in _PROFILE_FEATS)
                + ", count(*) AS n_samples FROM lineitem GROUP BY l_linenumber")


def _line_profiles(spark, sf):
    li = load(spark, sf, "lineitem").select("l_linenumber", *_PROFILE_FEATS)
    return segment.cluster_profiles(li, "l_linenumber", _PROFILE_FEATS)


@register("cluster_profiles", _PROFILE_SQL)
def q_cluster_profiles(spark, sf):
    return _line_profiles(spark, sf)


def _sql_trait(f: str) -> str:
    v = f"p.{f}_mean"
    txt = f"CAST(CAST(CAST({v} AS DECIMAL(38,4)) AS DECIMAL(38,2)) AS VARCHAR)"
    ratio = f"({v} - g.{f}) / abs(g.{f})"
    return (f"CASE WHEN g.{f} = 0 OR g.{f} IS NULL THEN NULL WHEN {ratio} > 0.15 THEN '{f} alto (' || {txt} || ')' "
            f"WHEN {ratio} < -0.15 THEN '{f} bajo (' || {txt} || ')' END")


@register("cluster_traits", f"""
WITH p AS ({_PROFILE_SQL}),
g AS (SELECT {', '.join(f'avg({f}_mean) AS {f}' for f in _PROFILE_FEATS)} FROM p),
t AS (SELECT p.cluster, p.n_samples, list_filter([{', '.join(_sql_trait(f) for f in _PROFILE_FEATS)}], lambda x: x IS NOT NULL) AS tr
      FROM p, g)
SELECT cluster, 'Clúster ' || CAST(cluster AS VARCHAR) || ' (' || CAST(n_samples AS VARCHAR) || ' clientes): ' ||
       CASE WHEN len(tr) > 0 THEN array_to_string(tr[1:4], ', ') ELSE 'perfil similar al promedio general' END AS description
FROM t""")
def q_cluster_traits(spark, sf):
    return segment.describe_clusters(_line_profiles(spark, sf), _PROFILE_FEATS)


@register("cluster_profile_long", f"""
WITH p AS ({_PROFILE_SQL})
UNPIVOT (SELECT cluster, {', '.join(f'{f}_mean' for f in _PROFILE_FEATS)} FROM p)
ON {', '.join(f'{f}_mean' for f in _PROFILE_FEATS)} INTO NAME feature VALUE mean""")
def q_cluster_profile_long(spark, sf):
    return segment.profile_long(_line_profiles(spark, sf), _PROFILE_FEATS)


# ---------------------------------------------------------------------------
# 2.9 chart data
# ---------------------------------------------------------------------------

from tessera.operators import chartdata, experiments  # noqa: E402


@register("missing_ranked", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) * 100.0 AS null_pct FROM {LI_NULLS}"
    for c in LI_NULLS_COLS))
def q_missing_ranked(spark, sf):
    return chartdata.missing_ranked(derived(spark, sf, "lineitem_nulls"))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sql_corr_pair(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    xa, yb = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    den = f"(stddev_samp({xa}) * stddev_samp({yb}))"
    return f"round_even(CASE WHEN {den} = 0 THEN NULL ELSE covar_samp({xa}, {yb}) / {den} END, 3) + 0.0"


@register("correlation", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_sql_corr_pair(a, b)} AS corr FROM {LI_NULLS}"
    for a in _CORR_COLS for b in _CORR_COLS))
def q_correlation(spark, sf):
    return chartdata.correlation(derived(spark, sf, "lineitem_nulls").select(*_CORR_COLS))


@register("histogram", """
WITH st AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi FROM events),
p AS (SELECT *, CAST(ceil(log2(n) + 1) AS INTEGER) AS k FROM st),
w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / k ELSE 1.0 END AS width FROM p),
b AS (SELECT CAST(least(floor((value - lo) / width), k - 1) AS INTEGER) AS bin, count(*) AS c
      FROM events, w WHERE value IS NOT NULL GROUP BY ALL),
g AS (SELECT CAST(r.range AS INTEGER) AS bin FROM w, range(w.k) r)
SELECT g.bin, lo + g.bin * width AS lower, lo + (g.bin + 1) * width AS upper,
       CAST(coalesce(b.c, 0) AS BIGINT) AS count, coalesce(b.c, 0) / (n * width) AS density
FROM g LEFT JOIN b USING (bin), w""")
def q_histogram(spark, sf):
    return chartdata.histogram(load(spark, sf, "events"), "value")


@register("kde", """
WITH st AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd FROM events),
p AS (SELECT *, sd * pow(n, -0.2) AS h, (hi - lo) / 99 AS step FROM st),
g AS (SELECT CAST(range AS INTEGER) AS point FROM range(100))
SELECT point, lo + point * step AS x,
       round_even(sum(exp(-0.5 * ((lo + point * step - value) / h) * ((lo + point * step - value) / h)))
                  / (n * h * sqrt(2 * pi())), 10) AS density
FROM events, p, g WHERE value IS NOT NULL GROUP BY point, lo, step, n, h""")
def q_kde(spark, sf):
    return chartdata.kde(load(spark, sf, "events"), "value")


@register("boxplot", """
WITH l AS (UNPIVOT (SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, value FROM events)
           ON event_id, user_id, value INTO NAME col VALUE x),
q AS (SELECT col, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY col)
SELECT q.col AS "column", q1, med AS median, q3,
       min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
       max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
       count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM l JOIN q USING (col) GROUP BY q.col, q1, med, q3""")
def q_boxplot(spark, sf):
    return chartdata.boxplot(load(spark, sf, "events"))


@register("value_counts", """
SELECT 'events' AS table_name, 'event_type' AS column_name, event_type AS value, count(*) AS frequency
FROM events WHERE event_type IS NOT NULL GROUP BY event_type
UNION ALL
SELECT 'conversations', 'role', role, count(*) FROM conversations WHERE role IS NOT NULL GROUP BY role""")
def q_value_counts(spark, sf):
    a = chartdata.value_counts(load(spark, sf, "events"), "event_type") \
        .select(F.lit("events").alias("table_name"), F.lit("event_type").alias("column_name"), "value", "frequency")
    b = chartdata.value_counts(load(spark, sf, "conversations"), "role") \
        .select(F.lit("conversations").alias("table_name"), F.lit("role").alias("column_name"), "value", "frequency")
    return a.unionByName(b)


# ---------------------------------------------------------------------------
# experiment log (V7, V8, S8, G15)
# ---------------------------------------------------------------------------

_MAJ_SQL = ("(SELECT doc_id, toxic, m.c AS prediction, CASE WHEN m.c = 1 THEN 1.0 ELSE 0.0 END AS score FROM labels, "
            "(SELECT toxic AS c FROM labels GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1) m)")


def _majority_scored(spark, sf) -> DataFrame:
    lab = load(spark, sf, "labels").select("doc_id", "toxic")
    m = classify.train_baseline(lab, "toxic", "most_frequent")
    return m.transform(lab, ["doc_id"]).select("doc_id", "toxic", "prediction",
                                               F.col("probability")[1].alias("score"))


def _scored_metrics(df: DataFrame) -> DataFrame:
    m = evaluate.classification_metrics(df, "toxic", "prediction", "binary", pos_label=1)
    a = evaluate.auc_binary(df, "toxic", "score", pos_label=1)
    return m.withColumn("_k", F.lit(1)).join(a.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _experiment_log(spark, sf) -> str:
    log_dir = shared_dir(spark, "experiments")
    experiments.log_experiment(spark, log_dir, "score_model", {"threshold": 0.5, "weights": "0.3/0.7"},
                               _scored_metrics(derived(spark, sf, "labels_scored")), "test")
    experiments.log_experiment(spark, log_dir, "majority", {"strategy": "most_frequent"},
                               _scored_metrics(_majority_scored(spark, sf)), "test")
    return log_dir


@register("log_experiment")
def q_log_experiment(spark, sf):
    log_dir = _experiment_log(spark, sf)
    return spark.read.parquet(log_dir)


@register("experiments_table")
def q_experiments_table(spark, sf):
    return experiments.experiments_table(spark, _experiment_log(spark, sf))


@register("experiments_csv")
def q_experiments_csv(spark, sf):
    table = experiments.experiments_table(spark, _experiment_log(spark, sf))
    path = experiments.export_csv(table, shared_dir(spark, "experiments-csv"))
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def _sql_model_metrics(name: str, src: str) -> str:
    return (f"SELECT '{name}' AS model, m.*, a.auc FROM ({_sql_metrics(src, 'toxic', 'prediction', 'binary', pos=1)}) m, "
            f"({_sql_auc(src, 'toxic', 'score', '1')}) a")


@register("metrics_long", f"""
UNPIVOT ({_sql_model_metrics('score_model', LBL_SCORED)} UNION ALL {_sql_model_metrics('majority', _MAJ_SQL)})
ON accuracy, f1, precision, recall, auc INTO NAME metric VALUE value""")
def q_metrics_long(spark, sf):
    return experiments.metrics_long(experiments.experiments_table(spark, _experiment_log(spark, sf)))


# ---------------------------------------------------------------------------
# 2.1 sources, sinks, metadata
# ---------------------------------------------------------------------------

from tessera import sources  # noqa: E402
from tessera.sources.delimited import separator_counts  # noqa: E402
from tessera.sources.excel import write_xlsx_parts  # noqa: E402


def _write_text(df: DataFrame, name: str, sep: str, spark) -> str:
    path = shared_dir(spark, name)
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


@register("load_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_load_csv(spark, sf):
    path = _write_text(load(spark, sf, "customer"), "customer-semicolon", ";", spark)
    return sources.read_delimited(spark, path)


@register("load_csv_text", """
SELECT doc_id, CASE WHEN text NOT IN ('', 'NA', 'N/A', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN text END AS text,
       lang, source FROM documents""")
def q_load_csv_text(spark, sf):
    """Whole texts, with their quotes and line ends, written as quoted CSV and read back."""
    path = shared_dir(spark, "documents-text")
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    docs.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return sources.read_delimited(spark, path, sep=",")


@register("load_tsv", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def q_load_tsv(spark, sf):
    path = _write_text(load(spark, sf, "part"), "part-tab", "\t", spark)
    return sources.read_delimited(spark, path, sep="\t")


@register("load_json", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def q_load_json(spark, sf):
    path = shared_dir(spark, "supplier") + ".json"
    load(spark, sf, "supplier").write.mode("overwrite").json(path)
    return sources.read_table(spark, path)


@register("load_json_columns", "SELECT doc_id, text, lang, n_chars FROM documents")
def q_load_json_columns(spark, sf):
    """Files of column-oriented documents, {column: {row: value}}, read back as one table."""
    path = shared_dir(spark, "documents-columns")
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    columns = [F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), c))).alias(c) for c in docs.columns]
    files = docs.groupBy(F.expr("doc_id div 500").alias("f")).agg(*columns).drop("f")
    one_each = files.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    one_each.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return sources.read_json(spark, path)


@register("load_excel", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def q_load_excel(spark, sf):
    path = shared_dir(spark, "nation-books") + ".xlsx"
    write_xlsx_parts(load(spark, sf, "nation"), path)
    return sources.read_table(spark, path)


@register("load_file", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def q_load_file(spark, sf):
    path = shared_dir(spark, "region") + ".csv"
    load(spark, sf, "region").write.mode("overwrite").option("header", True).csv(path)
    return sources.read_table(spark, path)


@register("detect_separator")
def q_detect_separator(spark, sf):
    path = _write_text(load(spark, sf, "customer"), "customer-pipe", "|", spark)
    first = sources.delimited.list_files(spark, path)[0]
    return separator_counts(spark, first).withColumn("chosen", F.lit(sources.detect_separator(spark, path)))


@register("table_metadata", """
SELECT count(*) AS n_rows, 6 AS n_cols,
  'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns,
  'bigint,bigint,string,double,timestamp_ntz,string' AS dtypes,
  round_even(sum(8 + 8 + coalesce(strlen(o_orderstatus), 0) + 8 + 8 + coalesce(strlen(o_orderpriority), 0))::DOUBLE
             / 1048576.0, 3) AS memory_mb
FROM orders""")
def q_table_metadata(spark, sf):
    return sources.table_metadata(load(spark, sf, "orders"))


# ---------------------------------------------------------------------------
# streaming: incremental scoring of arriving files (M6 re-aimed)
# ---------------------------------------------------------------------------

from tessera.streaming import score_stream  # noqa: E402


STREAM_FILE_ROWS = 500_000  # an arriving file, at every size of the input


@register("stream_scoring")
def q_stream_scoring(spark, sf):
    m = _model(spark, sf, "tree")
    src = shared_dir(spark, "stream-in")
    rows = derived(spark, sf, "lineitem_model").select(*LI_KEY, *MODEL_FEATURES)
    rows.write.mode("overwrite").option("maxRecordsPerFile", STREAM_FILE_ROWS).parquet(src)
    sink, ckpt = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-ckpt")
    q = score_stream(spark, m, src, rows.schema, sink, ckpt, keep_cols=LI_KEY)
    q.awaitTermination()
    return spark.read.parquet(sink)


@register("evaluate_model")
def q_evaluate_model(spark, sf):
    """Forest metrics and AUC on the test split."""
    s = lineitem_split(spark, sf).where(F.col("split") == "test")
    return classify.evaluate_model(_model(spark, sf, "forest"), _dealt(s), "weighted")


@register("roc_model")
def q_roc_model(spark, sf):
    """ROC points of the decision tree on the test split."""
    s = lineitem_split(spark, sf).where(F.col("split") == "test")
    return classify.roc_for_model(_model(spark, sf, "tree"), s)
