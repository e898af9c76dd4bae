"""Queries of event logs, text checks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import ledger, text
from tidemark.plans.registry import query, rounded, table
from tidemark.storage import shared_dir

# A case log derived from the events table: a case a user, all its events in time, statuses by place in the case. Every
# third case ends with a decision, every ninth has one more event after it.
_LOG = """(SELECT *, CASE WHEN user_id % 9 = 0 THEN n - 1 WHEN user_id % 3 = 0 THEN n END AS d FROM (SELECT 'c' || user_id AS case_id, CAST(row_number() OVER w AS BIGINT) AS sequence, count(*) OVER (PARTITION BY user_id) AS n, event_id, user_id, epoch_us(ts) AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""
_END = "sequence > 2 AND sequence = d"
_OUTCOME = "CASE WHEN user_id % 2 = 0 THEN 'rgs_reached' ELSE 'rgs_not_reached' END"
_KIND = f"CASE WHEN sequence = 1 THEN 'alert_created' WHEN sequence = 2 THEN 'review_started' WHEN {_END} THEN {_OUTCOME} ELSE 'evidence_attached' END"
_TO = f"CASE WHEN sequence = 1 THEN 'alert_open' WHEN {_END} THEN {_OUTCOME} ELSE 'under_review' END"
_ROLE = "CASE event_id % 4 WHEN 0 THEN 'investigator' WHEN 1 THEN 'authorized_rgs_reviewer' WHEN 2 THEN 'alert_ingestor' ELSE 'model_governance_reviewer' END"
LOG_SQL = f"(SELECT case_id, sequence, user_id, event_id, us, {_KIND} AS event_type, {_TO} AS to_status, 'u' || (event_id % 17) AS actor, {_ROLE} AS actor_role, user_id % 5 AS org FROM {_LOG})"


def case_log(spark, d) -> DataFrame:
    """The log without hashes: case_id, sequence, types, statuses, actors, times, rationales, metadata."""
    e = table(spark, d, "events")
    no, n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"), F.count("*").over(W.partitionBy("user_id"))
    r = e.select("user_id", "event_id", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("case_id"), no.alias("sequence"), n.alias("n"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at"))
    r = r.withColumn("d", F.expr("CASE WHEN user_id % 9 = 0 THEN n - 1 WHEN user_id % 3 = 0 THEN n END"))
    org = (F.col("user_id") % 5).cast("string")
    r = r.selectExpr("*", f"{_KIND} AS event_type", f"{_TO} AS to_status", "concat('u', CAST(event_id % 17 AS STRING)) AS actor", f"{_ROLE} AS actor_role", "concat('reason ', CAST(event_id % 31 AS STRING)) AS rationale").drop("n", "d")
    return r.withColumns({"from_status": F.lag("to_status").over(W.partitionBy("case_id").orderBy("sequence")), "organization_id": F.concat(F.lit("o"), org), "metadata_json": F.concat(F.lit('{"source": "events", "identity": {"organization_id": "o'), org, F.lit('"}}'))})


def hashed_log(spark, d) -> DataFrame:
    """The log with each event's own digest and the one before, as a writer would have stored them."""
    return ledger.chain_events(case_log(spark, d))


@query("evt1_ingest_accepted", "SELECT organization_id, trans_num, alert_id FROM (SELECT user_id % 5 AS organization_id, event_id % 4000 AS trans_num, event_id AS alert_id, (event_id * 7919) % 1000 / 1e3 AS s, row_number() OVER (PARTITION BY user_id % 5, event_id % 4000, (event_id * 7919) % 1000 / 1e3 >= 0.4 ORDER BY event_id) AS r FROM events) WHERE s >= 0.4 AND r = 1")
def evt1(spark, d):
    ok, _ = ledger.ingest_alerts(_alerts(spark, d))
    return ok.select("organization_id", "trans_num", "alert_id")


def _alerts(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select((F.col("user_id") % 5).alias("organization_id"), (k % 4000).alias("trans_num"), k.alias("alert_id"), (k * 7919 % 1000 / 1000.0).alias("model_score"), F.lit(0.4).alias("threshold"))


@query("evt1_ingest_rejected", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN s < 0.4 THEN 'below_threshold' WHEN r > 1 THEN 'duplicate_in_batch' END AS reason FROM (SELECT (event_id * 7919) % 1000 / 1e3 AS s, row_number() OVER (PARTITION BY user_id % 5, event_id % 4000, (event_id * 7919) % 1000 / 1e3 >= 0.4 ORDER BY event_id) AS r FROM events)) WHERE reason IS NOT NULL GROUP BY 1")
def evt1_rejected(spark, d):
    _, bad = ledger.ingest_alerts(_alerts(spark, d))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("evt2_fold_cases", f"SELECT case_id, max_by(to_status, sequence) AS status, max(CASE WHEN event_type = 'review_started' THEN actor END) AS assigned_to, max(sequence) AS version FROM {LOG_SQL} GROUP BY 1")
def evt2(spark, d):
    return ledger.fold_cases(case_log(spark, d)).select("case_id", "status", "assigned_to", "version")


@query("evt3_audit_transitions", f"""WITH l AS (SELECT *, coalesce(lag(to_status) OVER (PARTITION BY case_id ORDER BY sequence), '') AS prev FROM {LOG_SQL})
 SELECT case_id, sequence, CASE WHEN prev IN ('rgs_reached', 'rgs_not_reached') THEN 'change_after_terminal' ELSE 'not_allowed' END AS problem FROM l
 WHERE (prev || '>' || to_status) NOT IN ('>alert_open', 'alert_open>under_review', 'under_review>under_review', 'under_review>rgs_reached', 'under_review>rgs_not_reached')""")
def evt3(spark, d):
    return ledger.audit_transitions(case_log(spark, d))


@query("evt4_version_conflicts", f"SELECT case_id, sequence, sequence - 1 - CAST(event_id % 10 = 0 AS BIGINT) AS expected_version, sequence - 1 AS actual_version FROM {LOG_SQL} WHERE event_id % 10 = 0")
def evt4(spark, d):
    e = case_log(spark, d).withColumn("expected_version", F.col("sequence") - 1 - (F.col("event_id") % 10 == 0).cast("long"))
    return ledger.version_conflicts(e)


@query("evt5_win10_scl12_verify_chain", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sequence) AS r FROM {LOG_SQL} WHERE event_id % 50 <> 7)
 SELECT case_id, sequence, CASE WHEN sequence <> r THEN 'sequence_gap' WHEN event_id % 50 = 3 THEN 'broken_link' ELSE 'content_changed' END AS problem FROM l WHERE sequence <> r OR event_id % 50 IN (0, 1, 2, 3)""")
def evt5(spark, d):
    k = F.col("event_id") % 50  # afterwards some events go, some contents and links are changed
    e = hashed_log(spark, d).where(k != 7)
    changed = {"actor": F.when(k == 0, "intruder"), "rationale": F.when(k == 1, "another"), "from_status": F.when(k == 2, "nowhere"), "previous_event_hash": F.when(k == 3, F.lit("0" * 64))}
    return ledger.verify_chain(e.withColumns({c: F.coalesce(v, F.col(c)) for c, v in changed.items()}))


@query("evt6_build_chain", """WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
 h AS (SELECT conv_id, turn, r, sha256(chr(10) || x) AS event_hash FROM t WHERE r = 1 UNION ALL SELECT t.conv_id, t.turn, t.r, sha256(h.event_hash || chr(10) || t.x) FROM h JOIN t ON t.conv_id = h.conv_id AND t.r = h.r + 1) SELECT conv_id, turn, event_hash FROM h""")
def evt6(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return ledger.build_chain(rows, "conv_id", "turn", F.lit(""), F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))).select("conv_id", "turn", "event_hash")


_EVIDENCE = {3: "hash_mismatch", 5: "size_mismatch", 7: "content_without_record", 9: "record_without_event", 11: "sha256_differs", 12: "byte_size_differs", 13: "media_type_differs", 14: "local_path_differs", 15: "evidence_type_differs", 16: "unverified_receipt", 17: "archive_receipt_differs", 18: "record_without_content"}


@query("evt7_jn11_reconcile", f"""SELECT doc_id AS evidence_id, problem FROM documents JOIN (SELECT unnest([{', '.join(map(str, _EVIDENCE))}, 3, 5, 7]) AS r, unnest([{', '.join(f"'{x}'" for x in _EVIDENCE.values())}, 'sha256_differs', 'byte_size_differs', 'event_without_record']) AS problem) ON doc_id % 20 = r""")
def evt7(spark, d):
    """Records, contents and evidence events of every document, with one kind of fault a residue of its id."""
    k = F.col("doc_id") % 20
    docs = table(spark, d, "documents").where("doc_id is not null").withColumns({"sha": F.sha2(F.col("text").cast("binary"), 256), "size": F.octet_length("text").cast("long")})
    receipt = F.when(k >= 16, F.concat(F.lit('{"verified": '), F.when(k == 16, "false").otherwise("true"), F.lit(', "store": "a"}')))
    rec = docs.where(k != 7).select(F.col("doc_id").alias("evidence_id"), F.col("lang").alias("evidence_type"), F.when(k == 3, F.sha2("sha", 256)).otherwise(F.col("sha")).alias("sha256"), (F.col("size") + (k == 5).cast("long")).alias("byte_size"), F.lit("text/plain").alias("media_type"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("local_path"), receipt.alias("archive_receipt"))
    odd = lambda r, c: F.when(k == r, "other").otherwise(c)
    told = F.when(k >= 16, F.concat(F.lit('{"store":"a","verified":'), F.when((k == 16) | (k == 17), "false").otherwise("true"), F.lit("}")))
    meta = F.to_json(F.struct(odd(15, F.col("lang")).alias("evidence_type"), odd(11, F.col("sha")).alias("sha256"), (F.col("size") + (k == 12).cast("long")).alias("byte_size"), odd(13, F.lit("text/plain")).alias("media_type"), odd(14, F.concat(F.lit("d/"), F.col("doc_id").cast("string"))).alias("local_path"), F.from_json(told, "store string, verified boolean").alias("archive_receipt")))
    events = docs.where(k != 9).select(F.col("doc_id").alias("evidence_id"), meta.alias("metadata_json"))
    return ledger.reconcile(rec, docs.where(k != 18).select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("content")), events=events)


@query("evt8_audit_permissions", f"""WITH g AS (SELECT unnest(['investigator','investigator','investigator','authorized_rgs_reviewer','authorized_rgs_reviewer','authorized_rgs_reviewer','authorized_rgs_reviewer','authorized_rgs_reviewer','alert_ingestor']) AS actor_role, unnest(['alert_created','review_started','evidence_attached','alert_created','review_started','evidence_attached','rgs_reached','rgs_not_reached','alert_created']) AS event_type)
 SELECT case_id, sequence, 'not_permitted' AS problem FROM {LOG_SQL} l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.actor_role = l.actor_role AND g.event_type = l.event_type)""")
def evt8(spark, d):
    return ledger.audit_permissions(case_log(spark, d))


@query("evt9_unique_artifacts", "SELECT source AS case_id, lang AS evidence_type, sha256(text) AS sha256, min(doc_id) AS evidence_id, count(*) AS copies, CAST(max(strlen(text)) AS BIGINT) AS byte_size FROM documents GROUP BY 1, 2, 3")
def evt9(spark, d):
    return ledger.unique_artifacts(table(spark, d, "documents").select(F.col("source").alias("case_id"), F.col("lang").alias("evidence_type"), F.col("doc_id").alias("evidence_id"), F.col("text").alias("content")))


@query("evt10_organization_mismatches", f"SELECT case_id, 'o' || ((org + 1) % 5) AS organization_id, 'o' || org AS committed FROM {LOG_SQL} WHERE sequence = 1 AND user_id % 11 = 0")
def evt10(spark, d):
    log = case_log(spark, d)
    shift = F.when(F.col("user_id") % 11 == 0, 1).otherwise(0)
    cases = log.where("sequence = 1").select("case_id", F.concat(F.lit("o"), ((F.col("user_id") + shift) % 5).cast("string")).alias("organization_id"))
    return ledger.organization_mismatches(cases, log)


@query("agg18_win9_feedback_report", f"""WITH l AS {LOG_SQL}, p AS (SELECT case_id, any_value(user_id) AS u, min(CASE WHEN event_type = 'review_started' THEN us END) AS s, min(CASE WHEN event_type LIKE 'rgs%' THEN us END) AS e, max_by(to_status, sequence) AS st FROM l GROUP BY 1),
 g AS (SELECT 'v' || (u % 4) AS model_version, count(*) AS cases, count(*) FILTER (WHERE st LIKE 'rgs%') AS t, count(*) FILTER (WHERE st = 'rgs_reached') AS c, median(greatest(e - s, 0) / 3600000000.0) AS m FROM p GROUP BY 1)
 SELECT model_version, cases, cases < 38 AS suppressed, CASE WHEN cases >= 38 THEN round(t / cases, 6) END AS terminal_rate, CASE WHEN cases >= 38 THEN round(c / nullif(t, 0), 6) END AS confirmed_rate, CASE WHEN cases >= 38 THEN round(m, 6) END AS median_hours FROM g""")
def agg18(spark, d):
    log = case_log(spark, d)
    cases = log.where("sequence = 1").select("case_id", F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("model_version"))
    return rounded(ledger.feedback_report(cases, log, 38))


@query("srt4_list_cases", f"SELECT case_id, status, version FROM (SELECT case_id, max_by(to_status, sequence) AS status, max(sequence) AS version, max_by(us, sequence) AS u FROM {LOG_SQL} GROUP BY 1) WHERE status = 'under_review' ORDER BY u DESC, case_id LIMIT 50")
def srt4(spark, d):
    return ledger.list_cases(ledger.fold_cases(case_log(spark, d)), "under_review", 50).select("case_id", "status", "version")


# ---- texts: narratives made of the rows themselves, each with a figure that its payload has and one that it has not


def narratives(spark, d) -> DataFrame:
    from tidemark.plans.features import event_transactions
    from tidemark.operators import card

    t = card.history_and_velocity(event_transactions(spark, d)).withColumn("trans_date_trans_time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    body = F.concat(F.lit("WHO\nCard ending "), F.right((F.col("cc_num") + 4_000_000).cast("string"), F.lit(4)), F.lit(". WHAT\nThe amount of $"), F.format_string("%,.2f", "amt"), F.lit(" on "), F.substring("trans_date_trans_time", 1, 10), F.lit(" under section 7.1. "), F.when(F.col("trans_num") % 7 == 0, "A linked account was seen. ").otherwise(""), F.when(F.col("trans_num") % 5 == 0, "It is 98765 units.").otherwise("It may be so."))
    return t.select("trans_num", (F.col("cc_num") + 4_000_000).alias("cc_num"), "amt", "card_mean_amt", "card_std_amt", "amt_z_card", "txns_24h", "txns_7d", "trans_date_trans_time", body.alias("narrative"))


@query("txt1_txt3_txt4_txt5_grounding", "SELECT event_id AS trans_num, event_id % 5 <> 0 AND event_id % 7 <> 0 AS ok, CAST(event_id % 5 = 0 AS BIGINT) AS n_ungrounded, CAST(event_id % 7 = 0 AS BIGINT) AS n_claims FROM events")
def txt1(spark, d):
    g = text.ground(narratives(spark, d))
    return g.select("trans_num", "ok", F.size("ungrounded").cast("long").alias("n_ungrounded"), F.size("claims").cast("long").alias("n_claims"))


@query("txt2_quantities", r"""SELECT doc_id, CAST(len(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '(section|s\.|subsection|part|paragraph)\s*[\d.()]+', ' ', 'gi'), '\bPCMLTFA[\s,]*[\d.()]*', ' PCMLTFA ', 'gi'), '\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}(?::\d{2})?', ' ', 'g'), '-?\$?\d[\d,]*(?:\.\d+)?%?'), lambda x: TRY_CAST(regexp_replace(x, '[$,%]', '', 'g') AS DOUBLE)), lambda v: v IS NOT NULL AND v NOT IN (0,1,2,3,4,5,6,7,8,9,10,12,24,100,1000))) AS BIGINT) AS n FROM documents""")
def txt2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.quantities(F.col("text"))).cast("long").alias("n"))


@query("txt6_completeness", r"SELECT doc_id, CAST(len(list_filter(['WHO','WHAT','WHEN','WHERE','WHY','HOW'], lambda s: NOT contains(text, s))) AS BIGINT) AS missing, regexp_matches(text, '\b\d{12,19}\b') AS open_pan, CAST(len(list_filter(['might','possibly','could be','appears to'], lambda h: contains(' ' || lower(text) || ' ', ' ' || h || ' '))) AS BIGINT) AS hedges FROM documents")
def txt6(spark, d):
    return text.completeness(table(spark, d, "documents"), "text").select("doc_id", F.size("missing_sections").cast("long").alias("missing"), "open_pan", F.size("hedges").cast("long").alias("hedges"))


@query("txt7_sections", r"""SELECT c_custkey AS k, no, section, body FROM (SELECT c_custkey, unnest([0, 1, 2]) AS no, unnest(['INTRO', 'WHO', 'WHAT']) AS section, unnest(['Report.', c_name, c_mktsegment]) AS body FROM customer)""")
def txt7(spark, d):
    body = F.concat(F.lit("Report.\n## WHO\n"), F.col("c_name"), F.lit("\n2. **WHAT**\n"), F.col("c_mktsegment"), F.lit("\n"))
    return text.sections(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), body.alias("narrative")), "k")


# ---- streams: the events table as the source, run to its end; what the sink holds is the result


def _stream(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return spark.readStream.schema(e.schema).parquet(f"{d}/events.parque?")  # a pattern: the table may be one file


def _unique(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@query("str1_alert_stream", "SELECT user_id % 5 AS organization_id, event_id AS trans_num FROM events WHERE (event_id * 7919) % 1000 / 1e3 >= 0.4")
def str1(spark, d):
    from tidemark.streaming import jobs

    k = F.col("event_id")
    s = _stream(spark, d).select((F.col("user_id") % 5).alias("organization_id"), k.alias("trans_num"), (k * 7919 % 1000 / 1000.0).alias("model_score"), F.lit(0.4).alias("threshold"), F.col("ts").cast("timestamp").alias("event_time"))
    out = _unique(spark, "cases")
    jobs.ingest_stream(s, out, _unique(spark, "ck")).awaitTermination()
    return spark.read.parquet(out).select("organization_id", "trans_num")


@query("str2_velocity_stream", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 DAY' PRECEDING AND INTERVAL '1 MICROSECOND' PRECEDING) AS txns_24h, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7 DAYS' PRECEDING AND INTERVAL '1 MICROSECOND' PRECEDING) AS txns_7d FROM events")
def str2(spark, d):
    from tidemark.streaming import jobs

    out = _unique(spark, "velocity")
    jobs.velocity_stream(_stream(spark, d).select("event_id", "user_id", "ts"), out, _unique(spark, "ck"), key="user_id").awaitTermination()
    return rounded(spark.read.parquet(out).select("event_id", "txns_24h", "txns_7d"))


@query("str2_velocity_state", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 DAY' PRECEDING AND INTERVAL '1 MICROSECOND' PRECEDING) AS txns_24h, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7 DAYS' PRECEDING AND INTERVAL '1 MICROSECOND' PRECEDING) AS txns_7d FROM events")
def str2_state(spark, d):
    """The events in three parts in order of time, each a batch; a row behind all others moves the watermark past the last."""
    from tidemark.streaming import jobs

    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    source, out = _unique(spark, "arrivals"), _unique(spark, "state")
    us = F.unix_micros("ts")
    cuts, n = e.agg(F.percentile_approx(us, [1 / 3, 2 / 3]), F.count("*")).first()
    files = 1 + n // (1 << 21)  # of a part, so that no task writes a third of the table; a batch takes as many
    for part in (us < cuts[0], us.between(cuts[0], cuts[1] - 1), us >= cuts[1]):  # files are taken in order of their times
        (e.where(part).coalesce(1) if files == 1 else e.where(part).repartition(files)).write.mode("append").parquet(source)
    e.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 2 hours")).alias("ts")).write.mode("append").parquet(source)
    stream = jobs.state_session(spark).readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(source)
    jobs.velocity_state_stream(stream, out, _unique(spark, "late"), _unique(spark, "ck"), key="user_id", ident="event_id").awaitTermination()
    return rounded(spark.read.parquet(out).where("event_id is not null").select("event_id", "txns_24h", "txns_7d"))
