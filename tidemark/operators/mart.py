"""The feature mart: staging, history, velocity, encodings, interactions, graph and evaluation role in one chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import card, encoding, graph
from tidemark.operators.priors import percent_rank, rank_share, with_priors
from tidemark.settings import Settings
from tidemark.storage import written

KEYS = ("category", "state", "merchant")
#: The mart's 37 columns, in order (fixed values).
MART = (
    "row_id", "trans_num", "cc_num", "trans_date_trans_time", "dataset_split", "evaluation_role", "is_fraud", "amt", "log_amt", "distance_km", "night", "hour", "day_of_week", "hour_sin", "hour_cos", "is_online",
    "category_risk", "state_risk", "merchant_risk", "category_risk_serving", "state_risk_serving", "merchant_risk_serving", "card_txn_cnt", "card_mean_amt", "card_std_amt", "amt_z_card", "amt_over_mean_card",
    "txns_24h", "txns_7d", "amt_x_catRisk", "dist_x_online", "amt_x_night", "merchant_card_degree", "card_merchant_degree", "merchant_fraud_card_cnt", "merchant_fraud_card_ratio", "card_2hop_fraud_cards",
)


def stage(df: DataFrame, ts: str = "trans_date_trans_time") -> DataFrame:
    """Raw columns and hour, day_of_week (Monday 0) and night."""
    d = df.withColumns({"hour": S.hour_of(ts), "day_of_week": S.weekday_of(ts)})
    return d.withColumn("night", S.night("hour"))


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("dataset_split", F.lit("train")).unionByName(test.withColumn("dataset_split", F.lit("test")))


def _core() -> dict[str, Column]:
    s, c = S.cyclic(F.col("hour"))
    return {"log_amt": F.log1p("amt"), "distance_km": S.haversine_km(F.col("lat"), F.col("long"), F.col("merch_lat"), F.col("merch_long")), "hour_sin": s, "hour_cos": c, "is_online": S.online(F.col("category"))}


def core_features(df: DataFrame) -> DataFrame:
    return df.withColumns(_core())


def interactions(df: DataFrame) -> DataFrame:
    return df.withColumns({"amt_x_catRisk": F.col("amt") * F.col("category_risk"), "dist_x_online": F.col("distance_km") * F.col("is_online"), "amt_x_night": F.col("amt") * F.col("night")})


def role(rank: Column, fraction: float = 0.75, split: str = "dataset_split") -> Column:
    """Train rows develop the model; of the test rows the first ``fraction`` in time is held out, the rest is locked."""
    return F.when(F.col(split) == "train", "model_development").when(rank < fraction, "development_holdout").otherwise("locked_evaluation")


def evaluation_role(df: DataFrame, ts: str, key: str, fraction: float = 0.75) -> DataFrame:
    d = percent_rank(df, [ts, key], ["dataset_split"])
    return d.withColumn("evaluation_role", role(F.col("percent_rank"), fraction)).drop("percent_rank")


#: The mart's columns by the step that makes them, and what a step's columns are made of.
HISTORY = ("card_txn_cnt", "card_mean_amt", "card_std_amt", "amt_z_card", "amt_over_mean_card", "txns_24h", "txns_7d")
GRAPH = ("merchant_card_degree", "card_merchant_degree", "merchant_fraud_card_cnt", "merchant_fraud_card_ratio", "card_2hop_fraud_cards")
#: What follows from columns of the same row is made last, so that it isn't moved.
LATE = {
    "log_amt": ("amt",), "is_online": ("category",), "amt_z_card": ("amt", "card_mean_amt", "card_std_amt", "card_txn_cnt"), "amt_over_mean_card": ("amt", "card_mean_amt", "card_txn_cnt"),
    **dict.fromkeys(("hour", "day_of_week", "night", "hour_sin", "hour_cos"), ()),
}
PRODUCTS = {"amt_x_catRisk": ("amt", "category_risk"), "dist_x_online": ("distance_km", "is_online"), "amt_x_night": ("amt", "night")}


def build_mart(df: DataFrame, settings: Settings = Settings(), columns: Sequence[str] = MART) -> DataFrame:
    """37 columns from staged rows of both splits (raw columns, ``dataset_split``), or those of them, and raw ones, that
    ``columns`` names: steps that none of them comes from are left out, rows and values are the same.

    Rows move twice: by card for history and velocity, where the card's node features join, and by time for encodings and role
    together; merchants join at the end. Distances are made first, as they take less room than coordinates.
    """
    ts, split = "trans_date_trans_time", "dataset_split"
    used = {*columns, *(x for c in columns for x in PRODUCTS.get(c, ()))}
    used |= {x for c in used for x in LATE.get(c, ())}
    levels = [k for k in KEYS if used & {f"{k}_risk", f"{k}_risk_serving"}]
    history, role_asked, linked = used & {*HISTORY}, "evaluation_role" in used, used & {*GRAPH}
    used |= {ts, split, *(("cc_num", "amt") if history else ()), *(("cc_num", "merchant", "is_fraud") if linked else ()), *(("trans_num",) if role_asked or levels else ()), *(("is_fraud", *levels) if levels else ())}
    core = _core()
    d = df.withColumn("distance_km", core["distance_km"]) if "distance_km" in used else df
    d = d.select(*[c for c in d.columns if c in used and c not in LATE])
    cards = merchants = None
    if linked:
        blocks = graph.edge_blocks(d.where("dataset_split = 'train'"))
        cards, merchants = written(graph.card_nodes(blocks, "cc_num"), "cards"), graph.merchant_nodes(blocks, "merchant")
    if history:
        d = card.history_and_velocity(d, ts=ts, of_key=cards)
    elif linked:
        d = d.join(cards, "cc_num", "left")
    d = d.select(*[c for c in d.columns if c in used and c not in LATE or linked and c in cards.columns])
    # read by the borders, the totals and the rows of the encodings: written once, as each would compute the windows again
    d = (written(d, "mart-base") if role_asked or levels else d).where("dataset_split is not null")
    if role_asked or levels:
        sums = (encoding.train_sums("is_fraud") if levels else {}) | {"rows": F.lit(1).cast("long")}
        d = with_priors(d, [ts, "trans_num"], sums, ({"": None, **{k: F.col(k) for k in levels}} if levels else {}) | {"split": F.col(split)})
        d = encoding.encoded(d, levels, m=settings.smoothing, cold=settings.cold_start_prior) if levels else d
        d = d.withColumn("evaluation_role", role(rank_share(F.col("split_rows_prior"), F.col("split_rows_all")), settings.development_holdout_fraction))
    d = graph.with_graph(d, None, merchants) if linked else d
    d = stage(d).withColumns({c: x for c, x in {**core, **card.ratios()}.items() if c in used and c in LATE})
    return d.withColumns({c: F.col(a) * F.col(b) for c, (a, b) in PRODUCTS.items() if c in columns}).select(*columns)
