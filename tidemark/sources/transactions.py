"""Reading and writing transactions and marts, and the driver's tables in transaction columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.util import MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TXN = [
    ("column00", T.LongType()), ("trans_date_trans_time", T.TimestampNTZType()), ("cc_num", T.LongType()), ("merchant", T.StringType()), ("category", T.StringType()), ("amt", T.DoubleType()),
    ("first", T.StringType()), ("last", T.StringType()), ("gender", T.StringType()), ("street", T.StringType()), ("city", T.StringType()), ("state", T.StringType()), ("zip", T.StringType()),
    ("lat", T.DoubleType()), ("long", T.DoubleType()), ("city_pop", T.LongType()), ("job", T.StringType()), ("dob", T.DateType()), ("trans_num", T.StringType()), ("unix_time", T.LongType()),
    ("merch_lat", T.DoubleType()), ("merch_long", T.DoubleType()), ("is_fraud", T.IntegerType()),
]
TXN_SCHEMA = T.StructType([T.StructField(n, t) for n, t in _TXN])


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A transaction CSV with header: columns by position of the fixed schema, the running number as ``row_id``."""
    return spark.read.schema(TXN_SCHEMA).option("header", True).option("enforceSchema", True).csv(path).withColumnRenamed("column00", "row_id")


def read_role(spark: SparkSession, mart: str, *roles: str, ordered: bool = True) -> DataFrame:
    """A mart's rows of the given evaluation roles (partition pruning), in order of time and key."""
    df = spark.read.parquet(mart).where(F.col("evaluation_role").isin(*roles))
    return df.orderBy("trans_date_trans_time", "trans_num") if ordered else df


def sample_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows in key order: bounded and deterministic."""
    return df.orderBy(*keys).limit(n)


def write_mart(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("evaluation_role").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report table as JSON lines, one document a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def save_models(models: dict, metrics: DataFrame, path: str) -> None:
    """Fitted models under ``path``/<name>, and a row of metrics appended to the table beside them."""
    for name, model in models.items():
        if isinstance(model, MLWritable):
            model.write().overwrite().save(f"{path}/{name}")
        else:
            model.save(metrics.sparkSession, f"{path}/{name}")
    metrics.write.mode("append").parquet(f"{path}/metrics")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _located(df: DataFrame) -> DataFrame:
    cc, t = F.col("cc_num"), F.col("trans_num")
    df = df.withColumns({"lat": (cc * 37) % 12000 / F.lit(100.0) - 60.0, "long": (cc * 53) % 36000 / F.lit(100.0) - 180.0})
    return df.withColumns({"merch_lat": F.col("lat") + ((t * 11) % 100 - 50) / F.lit(100.0), "merch_long": F.col("long") + ((t * 13) % 100 - 50) / F.lit(100.0)})


def event_transactions(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as transactions: distinct microsecond times, train before 2024-01-22."""
    e = _table(spark, d, "events")
    return _located(
        e.select(
            F.col("event_id").alias("trans_num"), F.col("user_id").alias("cc_num"), F.col("ts"), F.col("value").alias("amt"), F.col("event_type").alias("category"),
            (F.col("event_id") * 31 % 97).alias("merchant"), (F.get_json_object("props", "$.k").cast("int") >= 90).cast("int").alias("is_fraud"),
            F.when(F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz"), "train").otherwise("test").alias("dataset_split"),
            (F.col("event_id") * 7919 % 1000 / F.lit(1000.0)).alias("p"),
        )
    )


def order_transactions(spark: SparkSession, d: str) -> DataFrame:
    """``orders`` as transactions: times are days, so one customer's rows of a day are peers."""
    o = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(_table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return _located(
        o.select(
            F.col("o_orderkey").alias("trans_num"), F.col("o_custkey").alias("cc_num"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amt"), F.col("o_orderpriority").alias("category"),
            F.col("n_name").alias("state"), (F.col("o_orderkey") * 31 % 97).alias("merchant"), (F.col("o_orderstatus") == "F").cast("int").alias("is_fraud"),
            F.when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "train").otherwise("test").alias("dataset_split"),
            (F.col("o_orderkey") * 7919 % 1000 / F.lit(1000.0)).alias("p"),
        )
    )


#: The same two views in DuckDB's SQL, for the oracles.
_LOC = """(cc_num*37) % 12000 / 1e2 - 60.0 AS lat, (cc_num*53) % 36000 / 1e2 - 180.0 AS long,
 (cc_num*37) % 12000 / 1e2 - 60.0 + ((trans_num*11) % 100 - 50) / 1e2 AS merch_lat, (cc_num*53) % 36000 / 1e2 - 180.0 + ((trans_num*13) % 100 - 50) / 1e2 AS merch_long"""
EVT_SQL = f"""(SELECT *, {_LOC} FROM (SELECT event_id AS trans_num, user_id AS cc_num, ts, value AS amt, event_type AS category, (event_id*31) % 97 AS merchant,
 CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90 AS INTEGER) AS is_fraud, CASE WHEN ts < TIMESTAMP '2024-01-22' THEN 'train' ELSE 'test' END AS dataset_split, (event_id*7919) % 1000 / 1e3 AS p FROM events))"""
ORD_SQL = f"""(SELECT *, {_LOC} FROM (SELECT o_orderkey AS trans_num, o_custkey AS cc_num, o_orderdate AS ts, o_totalprice AS amt, o_orderpriority AS category, n_name AS state, (o_orderkey*31) % 97 AS merchant,
 CAST(o_orderstatus = 'F' AS INTEGER) AS is_fraud, CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS dataset_split, (o_orderkey*7919) % 1000 / 1e3 AS p
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a time without zone (the session runs in UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def require_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The names that ``df`` lacks."""
    return [n for n in names if n not in df.columns]
