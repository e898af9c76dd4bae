"""Card history and velocity over event-time windows, without sliding frames.

A window's statistics come from one ordered line a card. Counts: each row adds to its windows when it comes and takes
itself out when it is as old as the window; the running sums are integers, so nothing is lost. Moments: time is cut into
blocks as long as the window, so that a window is the end of one block and the beginning of the next; the former stands
with the row that leaves last, the latter is a running aggregate, and both are merged. Nothing is subtracted, so that an
outlier leaves no trace, and a window of equal amounts is known by its least and largest.

Rows are dealt by card. A card of more rows than a chunk holds is cut into chunks of time instead, and what earlier
chunks hand on is worked out from one row a chunk. Work is linear in rows; rows of a card at one microsecond stay together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.scalars import over_mean, z_score
from tidemark.settings import DAY_US
from tidemark.sources.transactions import micros
from tidemark.storage import n_partitions

#: Default windows of the velocity features, in days.
WINDOWS = {"txns_24h": 1, "txns_7d": 7}
CHUNK_ROWS = 1 << 17  # of a card in one task; more where more than CHUNKS chunks would come of it
CHUNKS = 1 << 20  # whose borders are sent to all tasks, at most (8 MB)
MOST_CHUNKS = 1 << 12  # of one card

_BEGIN = W.unboundedPreceding
_KIND = "struct<n:bigint,s:double,m2:double,lo:double,hi:double>"


@dataclass(frozen=True)
class _Asked:
    """counts: name -> (length in microseconds, weight of a row); moments of ``amt`` over ``length``, if asked."""

    counts: dict[str, tuple[int, Column]]
    amt: str | None = None
    length: int = 0
    inclusive: bool = False
    lengths: list[int] = field(default_factory=list)


def _moments(x: Column, over) -> Column:
    n = F.count(x).over(over)
    return F.struct(n.alias("n"), F.sum(x).over(over).alias("s"), (n * F.var_pop(x).over(over)).alias("m2"), F.min(x).over(over).alias("lo"), F.max(x).over(over).alias("hi"))


def _merged(a: Column, b: Column) -> Column:
    """The moments of two sets of rows together; a null struct or one without rows is an empty set."""
    none = lambda m: m.isNull() | (m["n"] == 0)
    n, gap = a["n"] + b["n"], F.try_divide(a["s"], a["n"]) - F.try_divide(b["s"], b["n"])
    both = F.struct(n.alias("n"), (a["s"] + b["s"]).alias("s"), (a["m2"] + b["m2"] + F.try_divide(gap * gap * a["n"] * b["n"], n)).alias("m2"), F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))
    return F.when(none(a), b).when(none(b), a).otherwise(both)


def _chunk_of(at: Column) -> Column:
    """How many of the ascending ``__cuts`` are at or before ``at``, by halving."""
    steps = F.array(*[F.lit(MOST_CHUNKS >> i) for i in range(MOST_CHUNKS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.coalesce(F.get("__cuts", found + step - 1) <= at, F.lit(False)), found + step).otherwise(found))


def _carried(totals: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``totals`` (a row a chunk) with ``name``: the merged moments ``m`` of the rows before in ``order``, of the same ``by``."""
    every, before = W.partitionBy(*by), W.partitionBy(*by).orderBy(*order).rowsBetween(_BEGIN, -1)
    m = F.col("m")
    centre = F.try_divide(F.sum(m["s"]).over(every), F.sum(m["n"]).over(every))
    spread = m["m2"] + m["n"] * F.pow(F.try_divide(m["s"], m["n"]) - F.col("__centre"), F.lit(2))
    n, s = F.sum(m["n"]).over(before), F.sum(m["s"]).over(before)
    d = totals.withColumn("__centre", centre)
    moved = F.greatest(F.sum(spread).over(before) - n * F.pow(F.try_divide(s, n) - F.col("__centre"), F.lit(2)), F.lit(0.0))
    return d.withColumn(name, F.when(n > 0, F.struct(n.alias("n"), s.alias("s"), moved.alias("m2"), F.min(m["lo"]).over(before).alias("lo"), F.max(m["hi"]).over(before).alias("hi")))).drop("__centre")


def _grouped_moments(x: str) -> Column:
    return F.struct(F.count(x).alias("n"), F.sum(x).alias("s"), (F.count(x) * F.var_pop(x)).alias("m2"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def _line(d: DataFrame, key: str, asked: _Asked, cols: list[str], chunked: bool) -> DataFrame:
    """``cols`` of ``d`` (which has __us, __x, weights __w<i>, and __cuts, __last where ``chunked``) with the results."""
    part = ["__chunk"] if chunked else []
    names, block, blocked = list(asked.counts), None, []
    if chunked:
        d = d.withColumn("__chunk", _chunk_of(F.col("__us")))
    if asked.amt:
        block = lambda at: ((at - F.pmod(at, F.lit(asked.length))) / asked.length).cast("long")
        d = d.withColumn("__block", block(F.col("__us")))
        unit = W.partitionBy(key, "__block", *part)
        # counts run over blocks as well, if no window is longer: a block's seed brings what is in the windows at its start
        if max(n for n, _ in asked.counts.values()) <= asked.length:
            blocked = ["block"]
            alive = {n: F.when(F.col("__us") + length >= (F.col("__block") + 1) * asked.length, F.col(f"__w{i}")) for i, (n, (length, _)) in enumerate(asked.counts.items())}
            if not chunked:
                d = d.withColumns({f"__in{i}": F.coalesce(F.sum(alive[n]).over(unit), F.lit(0)) for i, n in enumerate(names)})
        d = d.withColumn("__left", _moments(F.col("__x"), unit.orderBy(F.desc("__us")).rangeBetween(_BEGIN, -1))).withColumn("__all", _moments(F.col("__x"), unit))
        first = F.row_number().over(unit.orderBy(F.desc("__us"))) == F.count("*").over(unit)  # one row, also among peers
        if chunked:
            ins = [F.sum(alive[n]).alias(f"__in{i}") for i, n in enumerate(names)] if blocked else []
            later = _carried(d.groupBy(key, "__block", "__chunk").agg(_grouped_moments("__x").alias("m"), *ins), [key, "__block"], [F.desc("__chunk")], "__later")
            of_block = W.partitionBy(key, "__block")
            opens = F.col("__chunk") == F.min("__chunk").over(of_block)
            ins = [F.coalesce(F.sum(f"__in{i}").over(of_block), F.lit(0)).alias(f"__in{i}") for i in range(len(names))] if blocked else []
            later = later.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), F.col("__chunk").alias("__c"), opens.alias("__opens"), "__later", *ins)
            d = d.withColumn("__first", first).join(later, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("__b")) & (F.col("__chunk") == F.col("__c"))).drop("__k", "__b", "__c")
            d = d.withColumns({"__left": _merged(F.col("__left"), F.col("__later")), "__all": _merged(F.col("__all"), F.col("__later"))})
            first = F.col("__first") & F.col("__opens")
        d = d.withColumn("__first", first)
    nothing, none = F.lit(0).cast("long"), F.lit(None).cast(_KIND)

    def entry(at: Column, deltas: dict[str, Column], kept: Column, x: Column, left: Column, blk: Column) -> Column:
        return F.struct(at.alias("at"), kept.alias("kept"), x.alias("x"), left.alias("left"), blk.alias("block"), *[deltas.get(n, nothing).alias(f"d{i}") for i, n in enumerate(names)])

    # times count twice, so that a block's seed stands before whatever happens at its start
    us, weight = F.col("__us"), {n: F.col(f"__w{i}") for i, n in enumerate(names)}
    payload = F.struct(*[F.col(f"`{c}`") for c in cols if c != key])
    nil, no_x, no_block = F.lit(None).cast(d.select(payload.alias("p")).schema["p"].dataType), F.lit(None).cast("double"), F.lit(0).cast("long")
    entries = [entry(2 * us + 1, weight, payload, F.col("__x"), none, F.col("__block") if asked.amt else no_block)]
    for length in asked.lengths:
        mine = {n: -weight[n] for n in names if asked.counts[n][0] == length}
        left = F.col("__left").cast(_KIND) if asked.amt and length == asked.length else none
        entries.append(entry(2 * (us + length) + 1, mine, nil, no_x, left, block(us + length) if asked.amt else no_block))
    if asked.amt:
        brought = {n: F.col(f"__in{i}") for i, n in enumerate(names)} if blocked else {}
        seed = entry(2 * (F.col("__block") + 1) * asked.length, brought, nil, no_x, F.col("__all").cast(_KIND), F.col("__block") + 1)
        entries.append(F.when(F.col("__first"), seed))
    e = d.select(key, *(["__cuts", "__last"] if chunked else []), F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("e"))
    if chunked:  # what leaves after a card's last row matters to nobody
        e = e.where(F.col("e.kept").isNotNull() | (F.col("e.at") <= 2 * F.col("__last") + 1)).withColumn("__chunk", _chunk_of(F.floor(F.col("e.at") / 2))).drop("__cuts", "__last")
    e = e.select(key, *part, "e.*")
    end = 0 if asked.inclusive else -1
    order = W.partitionBy(key, *blocked, *part).orderBy("at").rangeBetween(_BEGIN, end)
    e = e.withColumns({f"__r{i}": F.coalesce(F.sum(f"d{i}").over(order), nothing) for i in range(len(names))})
    if asked.amt:
        inside = W.partitionBy(key, "block", *part).orderBy("at").rangeBetween(_BEGIN, end)
        e = e.withColumns({"__head": _moments(F.col("x"), inside), "__tail": F.last("left", ignorenulls=True).over(inside)})
    rows = e.where("kept is not null")
    if chunked:
        sums = e.groupBy(key, *blocked, "__chunk").agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(len(names))])
        before = W.partitionBy(key, *blocked).orderBy("__chunk").rowsBetween(_BEGIN, -1)  # a row a chunk
        sums = sums.select(F.col(key).alias("__k"), F.col("__chunk").alias("__c"), *[F.col(c).alias("__b") for c in blocked], *[F.coalesce(F.sum(f"d{i}").over(before), nothing).alias(f"__o{i}") for i in range(len(names))])
        on = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__chunk") == F.col("__c"))
        rows = rows.join(sums, on & (F.col("block") == F.col("__b")) if blocked else on).drop("__k", "__c", "__b")
        rows = rows.withColumns({f"__r{i}": F.col(f"__r{i}") + F.col(f"__o{i}") for i in range(len(names))})
        if asked.amt:
            units = e.groupBy(key, "block", "__chunk").agg(_grouped_moments("x").alias("m"), F.max_by("left", F.when(F.col("left").isNotNull(), F.col("at"))).alias("left"))
            units = _carried(units, [key, "block"], [F.asc("__chunk")], "__earlier").withColumn("__gone", F.last("left", ignorenulls=True).over(W.partitionBy(key, "block").orderBy("__chunk").rowsBetween(_BEGIN, -1)))
            units = units.select(F.col(key).alias("__k"), F.col("block").alias("__b"), F.col("__chunk").alias("__c"), F.col("__earlier").cast(_KIND).alias("__earlier"), "__gone")
            rows = rows.join(units, F.col(key).eqNullSafe(F.col("__k")) & (F.col("block") == F.col("__b")) & (F.col("__chunk") == F.col("__c")))
            rows = rows.withColumns({"__head": _merged(F.col("__head"), F.col("__earlier")), "__tail": F.coalesce("__tail", "__gone")})
    out = [F.col(f"kept.`{c}`").alias(c) if c != key else F.col(key) for c in cols]  # the key itself: rows are still known to lie by it
    if asked.amt:
        rows = rows.withColumn("__m", _merged(F.col("__tail"), F.col("__head").cast(_KIND)))
    out += [F.col(f"__r{i}").alias(n) for i, n in enumerate(names)]
    return rows.select(*out, *(["__m"] if asked.amt else []))


def _cuts(timed: DataFrame, key: str, lengths: list[int], most: int, at_most: int) -> DataFrame:
    """(__k, __cuts, __last) of the keys with more than ``at_most`` rows: the times that cut what they bring and take
    into as many even chunks as they have ``at_most`` rows, and the time of their last row."""
    hot = timed.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"), F.max("__us").alias("__last")).where(F.col("__n") > at_most)
    times = F.explode(F.array(F.col("__us"), *[F.col("__us") + x for x in lengths])).alias("__at")
    every = timed.select(key, times).join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__k"))).where("__at <= __last")  # total / at_most rows at most
    fine = min(MOST_CHUNKS, max(2, -(-most // at_most)))
    sketch = every.groupBy("__k", "__n", "__last").agg(F.percentile_approx("__at", [i / fine for i in range(1, fine)], F.lit(10_000)).alias("__all"))
    parts = F.least(F.lit(fine), F.ceil(F.col("__n") / at_most)).cast("int")
    return sketch.select("__k", "__last", F.array_distinct(F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("__all", (i * fine / parts).cast("int")))).alias("__cuts"))


def _trailing(df: DataFrame, key: str, ts: str, counts: dict[str, tuple[float, Column]], amt: str | None = None, days: float = 0, inclusive: bool = False, chunk_rows: int | None = None, of_key: DataFrame | None = None) -> DataFrame:
    """``df`` with a column of each count (name -> (days, weight of a row)) over the rows of its key in [t - days, t), or
    (t - days, t] if ``inclusive``, and the moments ``__m`` of ``amt`` over ``days``.

    Rows without a key are rows of one card; rows without a time are in no window and have none. ``of_key`` has a row a key,
    and its columns join where the rows lie by key, so that they don't move again.
    """
    joined = lambda rows: rows if of_key is None else rows.join(of_key, key, "left")
    cols = [c for c in df.columns if c not in counts]
    lengths = {n: int(d * DAY_US) for n, (d, _) in counts.items()}
    asked = _Asked({n: (lengths[n], w) for n, (_, w) in counts.items()}, amt, int(days * DAY_US), inclusive, sorted({*lengths.values(), *([int(days * DAY_US)] if amt else [])}))
    weights = [F.coalesce(w.cast("long"), F.lit(0).cast("long")).alias(f"__w{i}") for i, (_, w) in enumerate(counts.values())]
    d = df.select(*[F.col(f"`{c}`") for c in cols], micros(ts).alias("__us"), (F.col(amt).cast("double") if amt else F.lit(None).cast("double")).alias("__x"), *weights)
    timed = d.where("__us is not null")
    total, most = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    at_most = max(chunk_rows or CHUNK_ROWS, total // CHUNKS)
    tasks = max(n_partitions(df.sparkSession), -(-total // CHUNK_ROWS))  # a task's memory doesn't grow with the table
    if most <= at_most:
        out = joined(_line(timed.repartition(tasks, key), key, asked, cols, chunked=False))
    else:
        marked = timed.join(F.broadcast(_cuts(timed, key, asked.lengths, most, at_most)), F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")  # CHUNKS borders at most
        rest = marked.where("__cuts is null").drop("__cuts", "__last")
        out = joined(_line(rest.repartition(tasks, key), key, asked, cols, chunked=False)).unionByName(joined(_line(marked.where("__cuts is not null"), key, asked, cols, chunked=True)))
    if not dict(df.dtypes)[ts].startswith("timestamp") or df.schema[ts].nullable:
        zero = {n: F.lit(0).cast("long") for n in counts} | ({"__m": F.lit(None).cast(_KIND)} if amt else {})
        out = out.unionByName(joined(df.select(*[F.col(f"`{c}`") for c in cols]).where(F.col(ts).isNull()).withColumns(zero)))
    return out


def _statistics(d: DataFrame) -> DataFrame:
    """``__m`` as card_mean_amt and card_std_amt, 0 where there is none; equal amounts have no deviation."""
    m, zero = F.col("__m"), F.lit(0.0)
    std = F.when(m["lo"] == m["hi"], zero).otherwise(F.sqrt(F.try_divide(m["m2"], m["n"] - 1)))
    mean = F.when(m["lo"] == m["hi"], m["lo"]).otherwise(F.try_divide(m["s"], m["n"]))
    return d.withColumns({"card_mean_amt": F.coalesce(mean, zero), "card_std_amt": F.coalesce(F.when(m["n"] > 1, std), zero)}).drop("__m")


def card_history(df: DataFrame, key: str = "cc_num", ts: str = "ts", amt: str = "amt", days: int = 90, chunk_rows: int | None = None) -> DataFrame:
    """``card_txn_cnt``, ``card_mean_amt``, ``card_std_amt`` of the ``days`` before each row, peers excluded; 0 if none."""
    return _statistics(_trailing(df, key, ts, {"card_txn_cnt": (days, F.lit(1))}, amt, days, chunk_rows=chunk_rows))


def velocity(df: DataFrame, key: str = "cc_num", ts: str = "ts", windows: dict[str, int] | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Counts of earlier rows in each window, over all splits together."""
    windows = windows or WINDOWS
    d = _trailing(df, key, ts, {n: (w, F.lit(1)) for n, w in windows.items()}, chunk_rows=chunk_rows)
    return d.withColumns({n: F.col(n).cast("int") for n in windows})


def history_and_velocity(df: DataFrame, key: str = "cc_num", ts: str = "ts", amt: str = "amt", days: int = 90, chunk_rows: int | None = None, of_key: DataFrame | None = None) -> DataFrame:
    """Both with the ratios that follow from them, on one line a card, and the columns of ``of_key`` (a row a card), if given."""
    counts = {"card_txn_cnt": (days, F.lit(1))} | {n: (w, F.lit(1)) for n, w in WINDOWS.items()}
    d = _statistics(_trailing(df, key, ts, counts, amt, days, chunk_rows=chunk_rows, of_key=of_key))
    return d.withColumns({**{n: F.col(n).cast("int") for n in WINDOWS}, **ratios(amt)})


def ratios(amt: str = "amt") -> dict[str, Column]:
    """What follows from a row's amount and its card's history."""
    a, mean, n = F.col(amt), F.col("card_mean_amt"), F.col("card_txn_cnt")
    return {"amt_z_card": z_score(a, mean, F.col("card_std_amt"), n), "amt_over_mean_card": over_mean(a, mean, n)}


def history_salted(df: DataFrame, key: str = "cc_num", ts: str = "ts", amt: str = "amt", days: int = 90) -> DataFrame:
    """As ``card_history`` for keys with very many rows: a row also goes to the next bucket of ``days``, windows stay
    inside (key, bucket), and only rows in their own bucket are kept. A key is spread over its buckets."""
    us = micros(ts)
    d = df.withColumn("__us", us).withColumn("__own", F.floor(F.col("__us") / int(days * DAY_US)))
    d = d.withColumn("__bucket", F.explode(F.array("__own", F.col("__own") + 1)))
    w = W.partitionBy(key, "__bucket").orderBy("__us").rangeBetween(-int(days * DAY_US), -1)
    zero = F.lit(0.0)
    d = d.withColumns({"card_txn_cnt": F.count("*").over(w), "card_mean_amt": F.coalesce(F.avg(amt).over(w), zero), "card_std_amt": F.coalesce(F.stddev_samp(amt).over(w), zero)})
    return d.where("__bucket = __own").drop("__us", "__own", "__bucket")


def inclusive_velocity(df: DataFrame, key: str = "cc_num", ts: str = "ts", days: int = 1, name: str = "txns_1d") -> DataFrame:
    """The legacy count over (t - days, t], the row and its peers included."""
    return _trailing(df, key, ts, {name: (days, F.lit(1))}, inclusive=True)


def training_velocity(df: DataFrame, key: str = "cc_num", ts: str = "ts", days: int = 1, split: str = "dataset_split", name: str = "train_txns") -> DataFrame:
    """Of each row that isn't a training row, the training rows of its key in (t - days, t]."""
    return _trailing(df, key, ts, {name: (days, F.col(split) == "train")}, inclusive=True).where(F.col(split) != "train")


def write_history(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """``df`` in folders a day (``day``), so that a look-back reads the days that it reaches and no others."""
    df.withColumn("day", F.to_date(ts)).repartition("day").write.mode(mode).partitionBy("day").parquet(path)


def reach(history: DataFrame, first_us: int, days: float, ts: str = "ts") -> DataFrame:
    """The rows of ``history`` from ``days`` before a time on. The limits are literals: they prune the folders of
    ``write_history`` and reach the scan of any other table."""
    since = F.timestamp_micros(F.lit(first_us - int(days * DAY_US))).cast(history.schema[ts].dataType)
    near = history.where(F.col(ts) >= since)
    return near.where(F.col("day") >= since.cast("date")).drop("day") if "day" in history.columns else near


def velocity_incremental(history: DataFrame, batch: DataFrame, key: str = "cc_num", ts: str = "ts", windows: dict[str, int] | None = None) -> DataFrame:
    """The velocity of ``batch`` from it and the part of ``history`` that its windows reach back to."""
    windows = windows or WINDOWS
    first = batch.agg(F.min(micros(ts))).first()[0]  # one value
    past = history.limit(0) if first is None else reach(history, first, max(windows.values()), ts)
    both = past.select(*batch.columns).withColumn("__new", F.lit(False)).unionByName(batch.withColumn("__new", F.lit(True)))
    return velocity(both, key, ts, windows).where("__new").drop("__new")


def lifetime_stats(rows: DataFrame, train: DataFrame, key: str = "cc_num", amt: str = "amt") -> DataFrame:
    """The legacy aggregates over all of a card's training rows, 0 for cards unseen."""
    s = train.groupBy(key).agg(F.count("*").alias("life_cnt"), F.avg(amt).alias("life_mean"), F.stddev_samp(amt).alias("life_std"))
    return rows.join(s, key, "left").na.fill(0, ["life_cnt"]).na.fill(0.0, ["life_mean", "life_std"])


def out_of_order(df: DataFrame, key: str, ts: str, ingest: str) -> DataFrame:
    """Rows of a key whose event time lies before that of the row ingested before them."""
    w = W.partitionBy(key).orderBy(ingest)
    return df.withColumn("prev_ts", F.lag(ts).over(w)).where(F.col(ts) < F.col("prev_ts"))
