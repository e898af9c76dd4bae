"""Queries of sources, scalars, windows, encodings, graph and mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import card, encoding, graph, mart
from tidemark.operators.priors import percent_rank, prior_sums
from tidemark.plans.registry import query, rounded, table
from tidemark.sources.transactions import EVT_SQL, ORD_SQL, TXN_SCHEMA, event_transactions, order_transactions, read_role, read_transactions, sample_rows, save_models, write_mart, write_report
from tidemark.storage import shared_dir

E, O = EVT_SQL, ORD_SQL
_R90 = "RANGE BETWEEN INTERVAL '90 DAYS' PRECEDING AND INTERVAL '1 MICROSECOND' PRECEDING"
_W = "(PARTITION BY cc_num ORDER BY ts {})"
_R1 = "RANGE BETWEEN INTERVAL '1 DAY' PRECEDING AND INTERVAL '1 MICROSECOND' PRECEDING"
_R7 = "RANGE BETWEEN INTERVAL '7 DAYS' PRECEDING AND INTERVAL '1 MICROSECOND' PRECEDING"
_HIST = f"""count(*) OVER h AS card_txn_cnt, coalesce(avg(amt) OVER h, 0) AS card_mean_amt, coalesce(stddev_samp(amt) OVER h, 0) AS card_std_amt,
 count(*) OVER d1 AS txns_24h, count(*) OVER d7 AS txns_7d"""
_WINS = f"WINDOW h AS {_W.format(_R90)}, d1 AS {_W.format(_R1)}, d7 AS {_W.format(_R7)}"
_Z = "CASE WHEN card_txn_cnt < 5 OR card_std_amt < 1e-9 THEN 0 ELSE (amt - card_mean_amt) / greatest(card_std_amt, 1.0) END"
_OM = "CASE WHEN card_txn_cnt = 0 THEN 1.0 ELSE amt / greatest(card_mean_amt, 1.0) END"

HISTORY = ["trans_num", "cc_num", "card_txn_cnt", "card_mean_amt", "card_std_amt", "txns_24h", "txns_7d"]


def history_sql(view: str) -> str:
    return f"""SELECT trans_num, cc_num, card_txn_cnt, round(card_mean_amt + 1e-9, 4) AS card_mean_amt, round(card_std_amt + 1e-9, 4) AS card_std_amt, txns_24h, txns_7d,
 round({_Z} + 1e-9, 4) AS amt_z_card, round({_OM} + 1e-9, 4) AS amt_over_mean_card FROM (SELECT *, {_HIST} FROM {view} {_WINS})"""


def _off_ties(df):
    """Means of cents often end in an exact half at the last place kept: both engines step off it before they round."""
    out = df.select(*HISTORY, "amt_z_card", "amt_over_mean_card")
    return rounded(out.withColumns({c: F.col(c) + 1e-9 for c in ("card_mean_amt", "card_std_amt", "amt_z_card", "amt_over_mean_card")}), 4)


@query("slice0_card_history_velocity", history_sql(E))
def slice0(spark, d):
    return _off_ties(card.history_and_velocity(event_transactions(spark, d)))


@query("crd1_card_history_orders", history_sql(O))
def crd1(spark, d):
    return _off_ties(card.history_and_velocity(order_transactions(spark, d)))


@query("crd1_card_history_salted", f"SELECT trans_num, card_txn_cnt, round(card_mean_amt, 4) AS card_mean_amt, round(card_std_amt, 4) AS card_std_amt FROM (SELECT *, {_HIST} FROM {O} {_WINS})")
def crd1_salted(spark, d):
    return rounded(card.history_salted(order_transactions(spark, d)).select("trans_num", "card_txn_cnt", "card_mean_amt", "card_std_amt"), 4)


@query("crd2_lifetime_stats", f"""WITH s AS (SELECT cc_num, count(*) AS life_cnt, avg(amt) AS life_mean, stddev_samp(amt) AS life_std FROM {E} WHERE dataset_split = 'train' GROUP BY 1)
 SELECT trans_num, coalesce(life_cnt, 0) AS life_cnt, round(coalesce(life_mean, 0), 4) AS life_mean, round(coalesce(life_std, 0), 4) AS life_std FROM {E} LEFT JOIN s USING (cc_num)""")
def crd2(spark, d):
    t = event_transactions(spark, d)
    return rounded(card.lifetime_stats(t, t.where("dataset_split = 'train'")).select("trans_num", "life_cnt", "life_mean", "life_std"), 4)


@query("win4_vel1_velocity", f"SELECT trans_num, count(*) OVER d1 AS txns_24h, count(*) OVER d7 AS txns_7d FROM {O} {_WINS}")
def vel1(spark, d):
    return rounded(card.velocity(order_transactions(spark, d)).select("trans_num", "txns_24h", "txns_7d"))


@query("vel2_velocity_incremental", f"SELECT trans_num, txns_24h, txns_7d FROM (SELECT *, count(*) OVER d1 AS txns_24h, count(*) OVER d7 AS txns_7d FROM {E} {_WINS}) WHERE dataset_split = 'test'")
def vel2(spark, d):
    t = event_transactions(spark, d)
    return rounded(card.velocity_incremental(t.where("dataset_split = 'train'"), t.where("dataset_split = 'test'")).select("trans_num", "txns_24h", "txns_7d"))


@query("win7_inclusive_velocity", f"SELECT trans_num, count(*) OVER (PARTITION BY cc_num ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS txns_1d FROM {E}")
def win7(spark, d):
    return card.inclusive_velocity(event_transactions(spark, d)).select("trans_num", "txns_1d")


@query("win8_training_velocity", f"""SELECT trans_num, n AS train_txns FROM (SELECT *, CAST(sum(CAST(dataset_split = 'train' AS INTEGER)) OVER (PARTITION BY cc_num ORDER BY epoch_us(ts) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM {E}) WHERE dataset_split <> 'train'""")
def win8(spark, d):
    return card.training_velocity(event_transactions(spark, d), days=7).select("trans_num", "train_txns")


_PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("win1_win2_prior_sums", f"""SELECT trans_num, CAST(coalesce(sum(is_fraud) OVER (ORDER BY ts, trans_num {_PRIOR}), 0) AS BIGINT) AS value_prior, count(*) OVER (ORDER BY ts, trans_num {_PRIOR}) AS count_prior,
 CAST(coalesce(sum(is_fraud) OVER (PARTITION BY category ORDER BY ts, trans_num {_PRIOR}), 0) AS BIGINT) AS category_value_prior, count(*) OVER (PARTITION BY category ORDER BY ts, trans_num {_PRIOR}) AS category_count_prior FROM {E}""")
def win1(spark, d):
    return prior_sums(event_transactions(spark, d).select("trans_num", "ts", "category", "is_fraud"), "is_fraud", ["ts", "trans_num"], ["category"]).drop("ts", "category", "is_fraud")


@query("win5_percent_rank", f"SELECT trans_num, round(percent_rank() OVER (PARTITION BY dataset_split ORDER BY ts, trans_num), 9) AS percent_rank FROM {E}")
def win5(spark, d):
    return rounded(percent_rank(event_transactions(spark, d).select("trans_num", "ts", "dataset_split"), ["ts", "trans_num"], ["dataset_split"]).select("trans_num", "percent_rank"), 9)


_ROLE = "CASE WHEN dataset_split = 'train' THEN 'model_development' WHEN percent_rank() OVER (PARTITION BY dataset_split ORDER BY ts, trans_num) < 0.75 THEN 'development_holdout' ELSE 'locked_evaluation' END"


@query("rol1_evaluation_role", f"SELECT trans_num, {_ROLE} AS evaluation_role FROM {O}")
def rol1(spark, d):
    return mart.evaluation_role(order_transactions(spark, d).select("trans_num", "ts", "dataset_split"), "ts", "trans_num").select("trans_num", "evaluation_role")


@query("win6_out_of_order", "SELECT o_orderkey, o_custkey, prev_ts FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_ts FROM orders) WHERE o_orderdate < prev_ts")
def win6(spark, d):
    return card.out_of_order(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "prev_ts")


def encoding_sql(view: str, keys: tuple[str, ...], extra: str = "") -> str:
    """Prequential and frozen encodings of ``keys`` over a transaction view, naively."""
    g = "(SELECT avg(is_fraud) FROM v WHERE dataset_split = 'train')"
    rate = f"coalesce(coalesce(sum(is_fraud) OVER (ORDER BY ts, trans_num {_PRIOR}), 0) / nullif(count(*) OVER (ORDER BY ts, trans_num {_PRIOR}), 0), 0.005)"
    tr = ", ".join(f"(coalesce(sum(is_fraud) OVER (PARTITION BY {k} ORDER BY ts, trans_num {_PRIOR}), 0) + 20.0 * {rate}) / (count(*) OVER (PARTITION BY {k} ORDER BY ts, trans_num {_PRIOR}) + 20.0) AS {k}_r" for k in keys)
    maps = ", ".join(f"m_{k} AS (SELECT {k}, (sum(is_fraud) + 20.0 * {g}) / (count(*) + 20.0) AS {k}_s FROM v WHERE dataset_split = 'train' GROUP BY 1)" for k in keys)
    joins = " ".join(f"LEFT JOIN m_{k} USING ({k})" for k in keys)
    cols = ", ".join(f"coalesce(t.{k}_r, m_{k}.{k}_s, {g}) AS {k}_risk, coalesce(m_{k}.{k}_s, {g}) AS {k}_risk_serving" for k in keys)
    return f"v AS (SELECT * FROM {view}), t AS (SELECT trans_num, {tr} FROM v WHERE dataset_split = 'train'), {maps}, enc AS (SELECT v.trans_num, {cols} FROM v LEFT JOIN t USING (trans_num) {joins})"


@query("enc1_enc2_enc3_target_encoding", f"WITH {encoding_sql(O, ('category', 'state', 'merchant'))} SELECT trans_num, {', '.join(f'round({k}_risk{s}, 9) AS {k}_risk{s}' for k in ('category', 'state', 'merchant') for s in ('', '_serving'))} FROM enc")
def enc1(spark, d):
    t = order_transactions(spark, d).select("trans_num", "ts", "category", "state", "merchant", "is_fraud", "dataset_split")
    return rounded(encoding.target_encode(t, mart.KEYS, "is_fraud", ["ts", "trans_num"]).drop("ts", "category", "state", "merchant", "is_fraud", "dataset_split"), 9)


@query("jn2_set2_encoding_maps", f"WITH {encoding_sql(O, ('category', 'state', 'merchant'))} SELECT trans_num, {', '.join(f'round({k}_risk{s}, 9) AS {k}_risk{s}' for k in ('category', 'state', 'merchant') for s in ('', '_serving'))} FROM enc")
def jn2(spark, d):
    """Encodings kept as maps by row, training and scoring rows united, then joined back to the rows."""
    t = order_transactions(spark, d).select("trans_num", "ts", "category", "state", "merchant", "is_fraud", "dataset_split")
    maps = [encoding.encoding_map(t, k, "is_fraud", ["ts", "trans_num"], "trans_num") for k in mart.KEYS]
    return rounded(encoding.join_maps(t.select("trans_num"), maps, "trans_num"), 9)


@query("enc4_in_sample_mean", f"SELECT trans_num, round(coalesce(m, 0), 9) AS category_leaky FROM {O} LEFT JOIN (SELECT category, avg(is_fraud) AS m FROM {O} WHERE dataset_split = 'train' GROUP BY 1) USING (category)")
def enc4(spark, d):
    t = order_transactions(spark, d)
    return rounded(encoding.in_sample_mean(t, t.where("dataset_split = 'train'"), "category", "is_fraud").select("trans_num", "category_leaky"), 9)


_STAGED = """CAST(extract(hour FROM ts) AS BIGINT) AS hour, CAST(extract(isodow FROM ts) - 1 AS BIGINT) AS day_of_week, CAST(CASE WHEN extract(hour FROM ts) >= 21 OR extract(hour FROM ts) < 6 THEN 1 ELSE 0 END AS BIGINT) AS night"""
_HAV = "2.0 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(merch_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(merch_lat)) * pow(sin(radians(merch_long - long) / 2), 2))))"


@query("src1_prj1_scl2_staged", f"SELECT trans_num, ts, {_STAGED} FROM {E}")
def staged(spark, d):
    return rounded(mart.stage(event_transactions(spark, d), "ts").select("trans_num", "ts", "hour", "day_of_week", "night"))


@query("scl5_scl8_core_features", f"""SELECT trans_num, round(sin(2.0 * pi() * extract(hour FROM ts) / 24.0), 9) + 0e0 AS hour_sin, round(cos(2.0 * pi() * extract(hour FROM ts) / 24.0), 9) + 0e0 AS hour_cos, round({_HAV}, 6) AS distance_km, round(ln(1 + amt), 9) AS log_amt,
 CAST(category LIKE '%_net' AS BIGINT) AS is_online FROM {E}""")
def scl5(spark, d):
    t = mart.core_features(mart.stage(event_transactions(spark, d), "ts")).select("trans_num", "hour_sin", "hour_cos", "distance_km", "log_amt", "is_online")
    out = rounded(t.withColumn("distance_km", F.round("distance_km", 6)), 9)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("hour_sin", "hour_cos")})  # no negative zero


@query("scl11_interactions", f"""WITH {encoding_sql(E, ('category',))} SELECT trans_num, round(amt * category_risk, 4) AS amt_x_cat_risk, round(({_HAV}) * CAST(category LIKE '%_net' AS INTEGER), 4) AS dist_x_online,
 round(amt * CASE WHEN extract(hour FROM ts) >= 21 OR extract(hour FROM ts) < 6 THEN 1 ELSE 0 END, 4) AS amt_x_night FROM v JOIN enc USING (trans_num)""")
def scl11(spark, d):
    t = mart.core_features(mart.stage(event_transactions(spark, d), "ts"))
    t = mart.interactions(encoding.target_encode(t, ["category"], "is_fraud", ["ts", "trans_num"]))
    return rounded(t.select("trans_num", F.col("amt_x_catRisk").alias("amt_x_cat_risk"), "dist_x_online", "amt_x_night"), 4)


@query("scl12_canonical_sha256", """SELECT o_orderkey, sha256('{"amount":' || CAST(CAST(o_totalprice * 100 AS BIGINT) AS VARCHAR) || ',"customer":' || CAST(o_custkey AS VARCHAR) || ',"status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def scl12(spark, d):
    o = table(spark, d, "orders")
    body = S.canonical_json(status=S.quoted(F.col("o_orderstatus")), customer=F.col("o_custkey").cast("string"), amount=F.round(F.col("o_totalprice") * 100).cast("long").cast("string"))
    return o.select("o_orderkey", F.sha2(body, 256).alias("digest"))


@query("scl13_mask_pan", """SELECT doc_id, CASE WHEN n = 0 THEN 'N/A' WHEN n <= 4 THEN repeat('*', n) ELSE '**** **** **** ' || right(g, 4) END AS masked FROM (SELECT doc_id, g, CAST(length(g) AS INTEGER) AS n FROM (SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS g FROM documents))""")
def scl13(spark, d):
    return table(spark, d, "documents").select("doc_id", S.mask_pan(F.col("text")).alias("masked"))


@query("scl14_mask_name", "SELECT c_custkey, substr(c_name, 1, 1) || '. ' || c_mktsegment AS masked FROM customer")
def scl14(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.mask_name(F.col("c_name"), F.col("c_mktsegment")).alias("masked"))


def _redact_sql() -> str:
    """The same patterns without looking around: a mark stands after every character that is no digit while cards are
    found, so that two cards with one character between them have a neighbour each."""
    text = "text"
    for p in S.SECRETS:
        text = f"regexp_replace({text}, '{p}', '[REDACTED]', 'g')"
    text = f"regexp_replace({text}, '{S.BEARER}', '\\1[REDACTED]', 'g')"
    text = f"regexp_replace({text}, '([^0-9])', '\\1' || chr(1), 'g')"
    text = f"regexp_replace({text}, '(^|\\x01)(?:[0-9](?:[ -]\\x01)?){{12,19}}($|[^0-9])', '\\1[REDACTED_PAN]\\2', 'g')"
    return f"SELECT doc_id, regexp_replace({text}, '([^0-9])\\x01', '\\1', 'g') AS redacted FROM documents"


@query("scl15_redact", _redact_sql())
def scl15(spark, d):
    return table(spark, d, "documents").select("doc_id", S.redact(F.col("text")).alias("redacted"))


@query("scl15_redacted_documents", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^0-9])(?:[0-9][ -]?){12,19}($|[^0-9])')")
def scl15_docs(spark, d):
    return table(spark, d, "documents").where(S.redact(F.col("text")) != F.col("text")).select("doc_id")


@query("scl16_hours_between", "SELECT event_id, round(greatest(epoch_us(ts) - epoch_us(lag_ts), 0) / 3600000000.0, 6) AS hours FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag_ts FROM events) WHERE lag_ts IS NOT NULL")
def scl16(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events").withColumn("prev", F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("prev is not null")
    iso = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return rounded(e.select("event_id", S.hours_between(iso("prev"), iso("ts")).alias("hours")))


@query("scl17_scl18_days_and_months", "SELECT user_id, strftime(ts, '%Y-%m') AS month, CAST(greatest((max(epoch_us(ts)) - min(epoch_us(ts))) // 86400000000, 1) AS BIGINT) AS days, count(DISTINCT CAST(ts AS DATE)) AS calendar_days FROM events GROUP BY 1, 2")
def scl17(spark, d):
    from tidemark.sources.transactions import micros

    e = table(spark, d, "events").withColumn("us", micros("ts"))
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(S.elapsed_days(F.min("us"), F.max("us")).cast("long").alias("days"), F.count_distinct(F.to_date("ts")).alias("calendar_days"))


@query("scl19_identifier_checks", r"SELECT s_suppkey, regexp_matches(s_name, '^[A-Za-z0-9][A-Za-z0-9._:@/-]{1,127}$') AS valid_id, regexp_matches(s_name, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AS valid_segment, length(trim(s_name)) >= 20 AS valid_rationale FROM supplier")
def scl19(spark, d):
    c = F.col("s_name")
    return table(spark, d, "supplier").select("s_suppkey", S.valid_identifier(c).alias("valid_id"), S.valid_segment(c).alias("valid_segment"), S.valid_rationale(c).alias("valid_rationale"))


@query("scl20_label_votes", """SELECT l_orderkey, l_linenumber, count(*) AS n, max(CASE WHEN v = '' THEN 'none' ELSE v END) AS votes FROM (SELECT l_orderkey, l_linenumber, concat_ws(', ', CASE WHEN l_discount * 10 > 0.5 THEN 'discount' END, CASE WHEN l_tax * 10 > 0.5 THEN 'tax' END) AS v FROM lineitem) GROUP BY 1, 2""")
def scl20(spark, d):
    votes = S.label_votes({"discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 10}, "none")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", votes.alias("votes")).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max("votes").alias("votes"))


@query("scl1_casts", "SELECT event_id, CAST(event_id AS DOUBLE) AS as_double, CAST(floor(value) AS INTEGER) AS as_int, TRY_CAST(event_type AS INTEGER) AS none FROM events")
def scl1(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_id").cast("double").alias("as_double"), F.floor("value").cast("int").alias("as_int"), F.col("event_type").try_cast("int").alias("none"))


@query("prj2_except_columns", "SELECT * EXCLUDE (o_orderpriority, o_totalprice), round(o_totalprice, 2) AS o_totalprice FROM orders")
def prj2(spark, d):
    o = table(spark, d, "orders")
    return o.drop("o_orderpriority").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("prj3_serving_aliases", f"WITH {encoding_sql(O, ('category',))} SELECT trans_num, round(category_risk_serving, 9) AS category_risk, round(amt, 2) AS amt FROM v JOIN enc USING (trans_num)")
def prj3(spark, d):
    t = order_transactions(spark, d).select("trans_num", "ts", "category", "amt", "is_fraud", "dataset_split")
    e = encoding.target_encode(t, ["category"], "is_fraud", ["ts", "trans_num"])
    return rounded(e.select("trans_num", *S.substituted(["category_risk", "amt"], {"category_risk": "category_risk_serving"})), 9)


@query("prj4_minimized", f"SELECT trans_num, CAST(NULL AS VARCHAR) AS trans_date_trans_time, cc_num, merchant, category, amt, {', '.join(f'CAST(NULL AS VARCHAR) AS {c}' for c in ('distance_km', 'night', 'card_mean_amt', 'amt_z_card', 'txns_24h', 'txns_7d', 'category_risk'))} FROM {E}")
def prj4(spark, d):
    return S.minimize(event_transactions(spark, d))


@query("jn1_cross_join_globals", f"SELECT trans_num, round(g, 9) AS global_rate, 5e-3 AS cold_prior FROM {O}, (SELECT avg(is_fraud) AS g FROM {O} WHERE dataset_split = 'train')")
def jn1(spark, d):
    t = order_transactions(spark, d)
    return t.select("trans_num").crossJoin(F.broadcast(t.where("dataset_split = 'train'").agg(F.round(F.avg("is_fraud"), 9).alias("global_rate")))).withColumn("cold_prior", F.lit(0.005))  # one row


@query("jn3_agg2_level_totals", f"SELECT trans_num, CAST(coalesce(s, 0) AS BIGINT) AS level_sum, coalesce(n, 0) AS level_n FROM {O} LEFT JOIN (SELECT state, sum(is_fraud) AS s, count(*) AS n FROM {O} WHERE dataset_split = 'train' GROUP BY 1) USING (state)")
def jn3(spark, d):
    t = order_transactions(spark, d)
    return t.join(encoding.level_totals(t.where("dataset_split = 'train'"), "state", "is_fraud"), "state", "left").select("trans_num", F.coalesce("level_sum", F.lit(0)).alias("level_sum"), F.coalesce("level_n", F.lit(0)).alias("level_n"))


@query("jn8_enrichment", "SELECT o_orderkey, o_totalprice, c_mktsegment, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jn8(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_totalprice", "c_mktsegment", "c_name")


@query("jn9_tolerance_join", "SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE abs(o_totalprice - s) > 1e3")
def jn9(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("s"))
    return table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")).where(F.abs(F.col("o_totalprice") - F.col("s")) > 1e3).select("o_orderkey")


# graph: customers and suppliers over all lines
_EDGES = "(SELECT DISTINCT o_custkey AS cc_num, l_suppkey AS merchant FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
GRAPH_LINES_SQL = "(SELECT o_custkey AS cc_num, l_suppkey AS merchant, CAST(l_returnflag = 'R' AS INTEGER) AS is_fraud FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_BAD = f"(SELECT DISTINCT cc_num FROM {GRAPH_LINES_SQL} WHERE is_fraud = 1)"


def graph_lines(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("cc_num"), F.col("l_suppkey").alias("merchant"), (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"))


@query("grf1_fraud_cards", f"SELECT cc_num FROM {_BAD}")
def grf1(spark, d):
    return graph.positive_keys(graph_lines(spark, d), "cc_num", "is_fraud")


@query("grf2_agg7_edges", f"SELECT cc_num, merchant FROM {_EDGES}")
def grf2(spark, d):
    return graph.edges(graph_lines(spark, d), "cc_num", "merchant")


@query("grf3_merchant_nodes", f"SELECT merchant, count(DISTINCT cc_num) AS merchant_card_degree, count(DISTINCT CASE WHEN b THEN cc_num END) AS merchant_fraud_card_cnt FROM (SELECT *, cc_num IN (SELECT cc_num FROM {_BAD}) AS b FROM {_EDGES}) GROUP BY 1")
def grf3(spark, d):
    t = graph_lines(spark, d)
    return graph.right_nodes(graph.edges(t, "cc_num", "merchant"), graph.positive_keys(t, "cc_num", "is_fraud"), "cc_num", "merchant")


@query("grf4_jn5_agg5_card_nodes", f"SELECT cc_num, count(DISTINCT merchant) AS card_merchant_degree, CAST(max(CASE WHEN b THEN 1 ELSE 0 END) AS BIGINT) AS card_is_fraud FROM (SELECT *, cc_num IN (SELECT cc_num FROM {_BAD}) AS b FROM {_EDGES}) GROUP BY 1")
def grf4(spark, d):
    t = graph_lines(spark, d)
    return rounded(graph.left_nodes(graph.edges(t, "cc_num", "merchant"), graph.positive_keys(t, "cc_num", "is_fraud"), "cc_num"))


_HOP = f"SELECT a.cc_num, count(DISTINCT CASE WHEN f.cc_num IS NOT NULL AND b.cc_num <> a.cc_num THEN b.cc_num END) AS card_2hop_fraud_cards FROM {_EDGES} a JOIN {_EDGES} b ON a.merchant = b.merchant LEFT JOIN {_BAD} f ON b.cc_num = f.cc_num GROUP BY 1"


@query("grf5_jn6_jn7_two_hop", _HOP)
def grf5(spark, d):
    t = graph_lines(spark, d)
    return graph.two_hop(graph.edges(t, "cc_num", "merchant"), graph.positive_keys(t, "cc_num", "is_fraud"), "cc_num", "merchant")


@query("grf6_jn4_graph_features", f"""WITH m AS (SELECT merchant, count(*) AS deg, count(CASE WHEN b THEN 1 END) AS bad FROM (SELECT *, cc_num IN (SELECT cc_num FROM {_BAD}) AS b FROM {_EDGES}) GROUP BY 1),
 c AS (SELECT cc_num, count(*) AS deg, max(CASE WHEN b THEN 1 ELSE 0 END) AS own FROM (SELECT *, cc_num IN (SELECT cc_num FROM {_BAD}) AS b FROM {_EDGES}) GROUP BY 1), h AS ({_HOP})
 SELECT cc_num, merchant, m.deg AS merchant_card_degree, c.deg AS card_merchant_degree, greatest(bad - own, 0) AS merchant_fraud_card_cnt, round(CASE WHEN m.deg > 1 THEN greatest(bad - own, 0) / (m.deg - 1) ELSE 0 END, 9) AS merchant_fraud_card_ratio, card_2hop_fraud_cards
 FROM {_EDGES} JOIN m USING (merchant) JOIN c USING (cc_num) JOIN h USING (cc_num)""")
def grf6(spark, d):
    out = graph.edges_with_graph(graph.edge_blocks(graph_lines(spark, d)))
    return rounded(out.select("cc_num", "merchant", "merchant_card_degree", "card_merchant_degree", "merchant_fraud_card_cnt", "merchant_fraud_card_ratio", "card_2hop_fraud_cards"), 9)


@query("grf7_agg3_agg6_density", f"SELECT count(*) AS edges, count(DISTINCT cc_num) AS cards, count(DISTINCT merchant) AS merchants, round(count(*) / (count(DISTINCT cc_num) * count(DISTINCT merchant)), 9) AS density FROM {_EDGES}")
def grf7(spark, d):
    return rounded(graph.density(graph.edges(graph_lines(spark, d), "cc_num", "merchant"), "cc_num", "merchant"), 9)


_TRAIN_EDGES = "(SELECT DISTINCT cc_num, merchant FROM v WHERE dataset_split = 'train')"
_TRAIN_BAD = "(SELECT DISTINCT cc_num FROM v WHERE dataset_split = 'train' AND is_fraud = 1)"
MART_SQL = f"""WITH {encoding_sql(O, mart.KEYS)},
 s AS (SELECT *, {_STAGED}, {_HIST}, {_ROLE} AS evaluation_role FROM v {_WINS}),
 eb AS (SELECT *, cc_num IN (SELECT cc_num FROM {_TRAIN_BAD}) AS b FROM {_TRAIN_EDGES}),
 m AS (SELECT merchant, count(*) AS mdeg, count(CASE WHEN b THEN 1 END) AS bad FROM eb GROUP BY 1),
 c AS (SELECT cc_num, count(*) AS cdeg, max(CASE WHEN b THEN 1 ELSE 0 END) AS own FROM eb GROUP BY 1),
 h AS (SELECT a.cc_num, count(DISTINCT CASE WHEN b.b AND b.cc_num <> a.cc_num THEN b.cc_num END) AS hop FROM eb a JOIN eb b ON a.merchant = b.merchant GROUP BY 1)
 SELECT trans_num AS row_id, trans_num, cc_num, ts AS trans_date_trans_time, dataset_split, evaluation_role, CAST(is_fraud AS BIGINT) AS is_fraud, round(amt, 4) AS amt, round(ln(1 + amt), 4) AS log_amt, round({_HAV}, 4) AS distance_km, night, hour, day_of_week,
 round(sin(2.0 * pi() * hour / 24.0), 4) + 0e0 AS hour_sin, round(cos(2.0 * pi() * hour / 24.0), 4) + 0e0 AS hour_cos, CAST(category LIKE '%_net' AS BIGINT) AS is_online,
 {', '.join(f'round({k}_risk{x}, 4) AS {k}_risk{x}' for k in mart.KEYS for x in ('', '_serving'))},
 card_txn_cnt, round(card_mean_amt, 4) AS card_mean_amt, round(card_std_amt, 4) AS card_std_amt, round({_Z}, 4) AS amt_z_card, round({_OM}, 4) AS amt_over_mean_card, txns_24h, txns_7d,
 round(amt * category_risk, 4) AS amt_x_catRisk, round(({_HAV}) * CAST(category LIKE '%_net' AS INTEGER), 4) AS dist_x_online, round(amt * night, 4) AS amt_x_night,
 coalesce(mdeg, 0) AS merchant_card_degree, coalesce(cdeg, 0) AS card_merchant_degree, greatest(coalesce(bad, 0) - coalesce(own, 0), 0) AS merchant_fraud_card_cnt,
 round(CASE WHEN coalesce(mdeg, 0) > 1 THEN greatest(coalesce(bad, 0) - coalesce(own, 0), 0) / (mdeg - 1) ELSE 0 END, 4) AS merchant_fraud_card_ratio, coalesce(hop, 0) AS card_2hop_fraud_cards
 FROM s JOIN enc USING (trans_num) LEFT JOIN m USING (merchant) LEFT JOIN c USING (cc_num) LEFT JOIN h USING (cc_num)"""


def orders_mart(spark, d, *columns):
    """The mart of the orders, or its ``columns``."""
    t = order_transactions(spark, d).withColumnRenamed("ts", "trans_date_trans_time").withColumn("row_id", F.col("trans_num"))
    return mart.build_mart(t, columns=columns or mart.MART)


@query("mrt1_feature_mart", MART_SQL)
def mrt1(spark, d):
    return rounded(orders_mart(spark, d), 4).withColumns({c: F.col(c) + 0.0 for c in ("hour_sin", "hour_cos")}).select(*mart.MART)


@query("snk1_src4_mart_roundtrip", f"SELECT trans_num, evaluation_role FROM (SELECT trans_num, {_ROLE} AS evaluation_role FROM {O}) WHERE evaluation_role <> 'model_development'")
def snk1(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/mart-{uuid.uuid4().hex}"
    write_mart(orders_mart(spark, d), path)
    return read_role(spark, path, "development_holdout", "locked_evaluation", ordered=False).select("trans_num", "evaluation_role")


@query("src5_sample_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500")
def src5(spark, d):
    return sample_rows(table(spark, d, "orders"), 500, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("set1_union_splits", "SELECT o_orderkey, 'train' AS dataset_split FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' UNION ALL SELECT o_orderkey, 'test' FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def set1(spark, d):
    o, day = table(spark, d, "orders"), F.lit("2000-01-01").cast("timestamp_ntz")
    return mart.union_splits(o.where(F.col("o_orderdate") < day), o.where(F.col("o_orderdate") >= day)).select("o_orderkey", "dataset_split")




@query("src1_src2_csv_transactions", f"SELECT trans_num AS row_id, CAST(trans_num AS VARCHAR) AS trans_num, ts AS trans_date_trans_time, cc_num, amt, '0' || CAST(cc_num % 10 AS VARCHAR) AS zip, CAST(is_fraud AS INTEGER) AS is_fraud FROM {O}")
def src1_csv(spark, d):
    """Orders written as a transaction CSV in the shared folder and read by the CSV source: zip codes keep their zero."""
    import uuid

    t = order_transactions(spark, d)
    none = F.lit("x")
    values = {
        "column00": F.col("trans_num"), "trans_date_trans_time": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "merchant": F.col("merchant").cast("string"), "zip": F.concat(F.lit("0"), (F.col("cc_num") % 10).cast("string")),
        "city_pop": F.lit(1), "dob": F.lit("1990-01-01"), "unix_time": F.lit(0), "trans_num": F.col("trans_num").cast("string"),
    }
    cols = [values.get(f.name, F.col(f.name) if f.name in t.columns else none).alias(f.name) for f in TXN_SCHEMA]
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    t.select(*cols).write.option("header", True).csv(path)
    return read_transactions(spark, path).select("row_id", "trans_num", "trans_date_trans_time", "cc_num", "amt", "zip", "is_fraud")


@query("snk2_report_roundtrip", f"SELECT dataset_split, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS positives FROM {E} GROUP BY 1")
def snk2(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(event_transactions(spark, d).groupBy("dataset_split").agg(F.count("*").alias("n"), F.sum("is_fraud").alias("positives")), path)
    return spark.read.schema("dataset_split string, n long, positives long").json(path)


@query("snk3_saved_models")
def snk3(spark, d):
    """A fitted model saved, loaded and used to score: key and probability."""
    import uuid

    from pyspark.ml import PipelineModel

    from tidemark.operators import models

    t = event_transactions(spark, d).select("trans_num", "amt", F.hour("ts").cast("double").alias("hour"), "is_fraud", "dataset_split")
    path = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    fitted = models.simple_baseline(t.where("dataset_split = 'train'"), "is_fraud", ["amt", "hour"])
    save_models({"baseline": fitted}, t.agg(F.count("*").alias("rows")), path)
    return models.score_baseline(t.where("dataset_split = 'test'"), PipelineModel.load(f"{path}/baseline")).select("trans_num", "p")
