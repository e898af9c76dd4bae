"""Narrative checks over tables: which figures a text may state, which it states, and what it claims without data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number and date patterns, structural constants, unsupported claims with their reasons, sections, hedges, the payload's
# numeric fields, risks and scores; further down the words of the summary.
NUMBER = r"-?\$?\d[\d,]*(?:\.\d+)?%?"
DATETIME = r"\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}(?::\d{2})?"
STATUTE = r"(?i)(section|s\.|subsection|part|paragraph)\s*[\d.()]+"
ACT = r"(?i)\bPCMLTFA[\s,]*[\d.()]*"
STRUCTURAL = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 24, 100, 1000)
CLAIMS = (
    (r"\b(last|previous|prior|preceding)\s+(documented\s+)?(transaction|purchase|activity|location)\b", "prior-transaction detail was not supplied"),
    (r"\b(physically )?impossible to (traverse|travel|reach)\b", "travel-time inference requires a prior location and timestamp that were not supplied"),
    (r"\b(ip address|device (id|fingerprint|identifier)|mac address|user agent)\b", "no device or network telemetry was supplied"),
    (r"\b(beneficial owner|kyc|know.your.customer|account opening|onboarding)\b", "no KYC or account-origination data was supplied"),
    (r"\b(other|related|linked)\s+account(s)?\b", "no counterparty or linked-account data was supplied"),
    (r"\b(chargeback|dispute|prior report|previously reported|earlier str|earlier sar)\b", "no case history was supplied"),
    (r"\b(customer (was|has been) contacted|confirmed with the (customer|cardholder))\b", "no customer contact record was supplied"),
)
SECTIONS = ("WHO", "WHAT", "WHEN", "WHERE", "WHY", "HOW")
HEDGES = ("might", "possibly", "could be", "appears to")
HEADING = r"(?i)(?:^|\n)(?:\d+\.\s*)?[\s#*]*(WHO|WHAT|WHEN|WHERE|WHY|HOW)[\s#*:\-]*(?=\n|$)"
NUMERIC_FIELDS = (
    "amt", "distance_km", "card_mean_amt", "card_std_amt", "amt_z_card", "amt_over_mean_card", "txns_24h", "txns_7d", "category_risk", "state_risk", "merchant_risk", "card_txn_cnt", "lat", "long", "merch_lat", "merch_long",
    "zip", "city_pop", "hour", "day_of_week", "night", "is_online", "log_amt",
)
RISKS = ("category_risk", "state_risk", "merchant_risk")
SCORES = ("p_m2", "p_m3", "p_m4", "meta")
NUMBERS = "array<double>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where lambdas in it find the value made instead of making it an element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("double"))


def entitled_values(columns: list[str]) -> Column:
    """array<double> of the quantities that a payload with these columns entitles a text to, as they are."""
    here = set(columns)
    col = lambda c: F.col(c).try_cast("double") if c in here else F.lit(None).cast("double")
    base: list[Column] = [col(c) for c in NUMERIC_FIELDS if c in here]
    base += [x for c in SCORES if c in here for x in (col(c), col(c) * 100)]
    base += [col(c) * 100 for c in RISKS if c in here]
    if "cc_num" in here:
        digits = F.regexp_replace(F.col("cc_num").cast("string"), r"\D", "")
        base.append(F.when(F.length(digits) >= 4, F.right(digits, F.lit(4)).try_cast("double")))
    amt, mean, std = col("amt"), col("card_mean_amt"), col("card_std_amt")
    given = (amt != 0) & (mean != 0)
    ratio = F.try_divide(amt, mean)
    base += [F.when(given, x) for x in (ratio, ratio * 100, (ratio - 1) * 100, amt - mean)]
    base.append(F.when(given & (std != 0), F.try_divide(amt - mean, std)))
    v24, v7 = col("txns_24h"), col("txns_7d")
    base += [F.when((v24 != 0) & (v7 != 0), x) for x in (F.try_divide(v7, v24), v7 - v24)]
    raw = F.array(*[b.cast("double") for b in base])
    if "trans_date_trans_time" in here:
        raw = F.concat(raw, _numbers_in(F.coalesce(F.col("trans_date_trans_time").cast("string"), F.lit(""))))
    return F.filter(raw, lambda v: v.isNotNull() & ~F.isnan(v))


def _shapes(v: Column) -> Column:
    """What a text may write for a value."""
    return F.array(F.round(v, 4), F.round(v, 2), F.round(v, 1), F.bround(v, 0), F.abs(F.round(v, 2)))


def allowed_values(columns: list[str]) -> Column:
    """array<double> of every quantity that a text may state for a payload with these columns."""
    return F.array_distinct(F.flatten(F.transform(entitled_values(columns), _shapes)))


def scrubbed(text: Column) -> Column:
    """Without what names statutes."""
    return F.regexp_replace(F.regexp_replace(text, STATUTE, " "), ACT, " PCMLTFA ")


def quantities(text: Column, clean: Column | None = None) -> Column:
    """array<struct<token, value>> of a text's numbers that aren't structural constants; statutes, dates, times aside.
    ``clean``: the text ``scrubbed``, if it is at hand."""
    clean = F.regexp_replace(scrubbed(text) if clean is None else clean, DATETIME, " ")
    tokens = F.regexp_extract_all(clean, F.lit(NUMBER), F.lit(0))
    parsed = F.transform(tokens, lambda t: F.struct(t.alias("token"), F.regexp_replace(t, "[$,%]", "").try_cast("double").alias("value")))
    return F.filter(parsed, lambda p: p.value.isNotNull() & ~p.value.isin(*[float(x) for x in STRUCTURAL]))


def date_tokens(text: Column, ts: Column, clean: Column | None = None) -> Column:
    """array<struct<token, ok>> of dates and times; ok: all their parts stand in the time, 12-hour forms included."""
    parts = _numbers_in(F.coalesce(ts.cast("string"), F.lit("")))
    halves = lambda p: F.transform(F.filter(p, lambda x: x.between(0, 23)), lambda h: F.when(h % 12 == 0, 12.0).otherwise(h % 12))
    known = _once(parts, lambda p: F.concat(p, halves(p)))
    return _once(known, lambda known: F.transform(F.regexp_extract_all(scrubbed(text) if clean is None else clean, F.lit(DATETIME), F.lit(0)), lambda t: F.struct(t.alias("token"), F.forall(_numbers_in(t), lambda x: F.array_contains(known, x)).alias("ok"))))


def is_grounded(value: Column, allowed: Column, rel: float = 0.01, abs_tol: float = 0.01) -> Column:
    return F.exists(allowed, lambda a: F.abs(value - a) <= F.greatest(F.lit(abs_tol), F.abs(a) * rel))


def is_entitled(value: Column, entitled: Column, rel: float = 0.01, abs_tol: float = 0.01) -> Column:
    """``is_grounded`` by what the ``entitled_values`` may be written as. A shape is less than 0.6 from its value or the
    value's amount, so values farther off than that and the tolerance are passed over before anything is rounded."""
    reach = lambda v: 0.6 + abs_tol + 2 * rel * (F.abs(v) + 1)
    near = F.filter(entitled, lambda v: (F.abs(value - v) <= reach(v)) | (F.abs(value - F.abs(v)) <= reach(v)))
    return F.exists(near, lambda v: is_grounded(value, _shapes(v), rel, abs_tol))


def unsupported_claims(text: Column) -> Column:
    """array<struct<phrase, reason>>, the first match of each pattern."""
    found = F.array(*[F.struct(F.regexp_extract(text, "(?i)" + p, 0).alias("phrase"), F.lit(r).alias("reason")) for p, r in CLAIMS])
    return F.filter(found, lambda x: x.phrase != "")


def ground(df: DataFrame, narrative: str = "narrative") -> DataFrame:
    """``df`` with grounded and ungrounded tokens, claims, ``ok`` and a summary; payload columns are those of ``df``."""
    text = F.coalesce(F.col(narrative), F.lit(""))
    ts = F.col("trans_date_trans_time") if "trans_date_trans_time" in df.columns else F.lit(None).cast("string")
    d = df.withColumn("__clean", scrubbed(text))
    d = d.withColumns({"__entitled": entitled_values(df.columns), "__q": quantities(text, F.col("__clean")), "__t": date_tokens(text, ts, F.col("__clean")), "claims": unsupported_claims(text)})
    q = _once(F.col("__entitled"), lambda e: F.transform("__q", lambda x: F.struct(x.token.alias("token"), is_entitled(x.value, e).alias("ok"))))
    d = d.withColumn("__all", F.concat("__t", q))
    pick = lambda ok: F.transform(F.filter("__all", lambda x: x.ok == ok), lambda x: x.token)
    d = d.withColumns({"grounded": pick(True), "ungrounded": pick(False)}).withColumn("ok", (F.size("ungrounded") == 0) & (F.size("claims") == 0))
    parts = F.concat_ws(
        " | ",
        F.when(F.size("ungrounded") > 0, F.concat(F.size("ungrounded").cast("string"), F.lit(" ungrounded quantity/quantities: "), F.array_join(F.slice("ungrounded", 1, 8), ", "))),
        F.when(F.size("claims") > 0, F.concat(F.size("claims").cast("string"), F.lit(" claim(s) about unsupplied data: "), F.array_join(F.transform(F.slice("claims", 1, 4), lambda c: c.reason), "; "))),
    )
    done = F.concat(F.lit("GROUNDED: all "), F.size("grounded").cast("string"), F.lit(" quantities trace to the payload."))
    return d.withColumn("summary", F.when(F.col("ok"), done).otherwise(F.concat(F.lit("UNGROUNDED -- "), parts))).drop("__clean", "__entitled", "__q", "__t", "__all")


def completeness(df: DataFrame, text: str = "narrative") -> DataFrame:
    """``df`` with missing sections, whether a card number stands open, required phrases, and hedging words (advisory)."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    return df.withColumns(
        {
            "missing_sections": F.filter(F.array(*[F.when(~t.contains(s), s) for s in SECTIONS]), lambda x: x.isNotNull()),
            "open_pan": t.rlike(r"\b\d{12,19}\b"),
            "cites_law": low.contains("fintrac") | low.contains("pcmltfa"),
            "cites_threshold": low.contains("reasonable grounds to suspect") | low.contains("rgs"),
            "hedges": F.filter(F.array(*[F.when(F.concat(F.lit(" "), low, F.lit(" ")).contains(f" {h} "), h) for h in HEDGES]), lambda x: x.isNotNull()),
        }
    ).withColumn("complete", (F.size("missing_sections") == 0) & ~F.col("open_pan") & F.col("cites_law") & F.col("cites_threshold"))


def sections(df: DataFrame, key: str, text: str = "narrative") -> DataFrame:
    """(key, no, section, body): the parts under the section headings; INTRO before the first."""
    t = F.coalesce(F.col(text), F.lit(""))
    bodies, names = F.split(t, HEADING, -1), F.regexp_extract_all(t, F.lit(HEADING), F.lit(1))
    d = df.select(key, F.posexplode(bodies).alias("no", "body"), names.alias("__n"))
    return d.select(key, "no", F.when(F.col("no") == 0, "INTRO").otherwise(F.upper(F.get("__n", F.col("no") - 1))).alias("section"), F.trim(F.col("body"), F.lit(" \n\t\r")).alias("body")).where("body <> '' or no > 0")
