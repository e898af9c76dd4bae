"""Jobs over case event logs: ingestion rules, folding, audits, hash chains, reconciliation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pyspark.sql import types as T

from tidemark.functions.scalars import canonical_json, canonical_text, hours_between, quoted
from tidemark.operators.priors import quantiles
from tidemark.storage import n_partitions

# The paths a case may take, and which permission an event asks for.
TRANSITIONS = (("", "alert_open"), ("alert_open", "under_review"), ("under_review", "under_review"), ("under_review", "rgs_reached"), ("under_review", "rgs_not_reached"))
TERMINAL = ("rgs_reached", "rgs_not_reached")
PERMISSION_OF = (("alert_created", "create_alert"), ("review_started", "start_review"), ("evidence_attached", "attach_evidence"), ("rgs_reached", "record_rgs_decision"), ("rgs_not_reached", "record_rgs_decision"))
COMMITTED = ("evidence_type", "sha256", "byte_size", "media_type", "local_path", "archive_receipt")  # what an evidence event repeats of its record
ROLE_PERMISSIONS = {
    "investigator": ("read_case", "create_alert", "start_review", "attach_evidence", "verify_integrity"),
    "authorized_rgs_reviewer": ("read_case", "create_alert", "start_review", "attach_evidence", "record_rgs_decision", "verify_integrity"),
    "model_governance_reviewer": ("read_case", "compare_models", "promote_model", "export_operational_feedback"),
    "alert_ingestor": ("create_alert", "ingest_alert"),
}


def reject_reason(score: str = "model_score", threshold: str = "threshold", key: str = "trans_num") -> Column:
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(0, 1)
    return F.when(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""), "missing_key").when(bad(score), "bad_score").when(bad(threshold), "bad_threshold").when(F.col(score) < F.col(threshold), "below_threshold")


def ingest_alerts(alerts: DataFrame, cases: DataFrame | None = None, keys: tuple[str, str] = ("organization_id", "trans_num"), order: str = "alert_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``): valid alerts, the first a key, that have no case yet."""
    d = alerts.withColumn("reason", reject_reason())
    first = F.row_number().over(W.partitionBy(*keys, F.col("reason").isNull()).orderBy(order))
    d = d.withColumn("reason", F.coalesce("reason", F.when(first > 1, "duplicate_in_batch")))
    if cases is not None:
        known = cases.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__known", F.lit(True))
        d = d.join(known, [F.col(k) == F.col(f"__{k}") for k in keys], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("__known"), "duplicate_case"))).drop("__known", *[f"__{k}" for k in keys])
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def fold_cases(events: DataFrame) -> DataFrame:
    """Per case its current status, assignee, version and last activity."""
    e = events
    return e.groupBy("case_id").agg(
        F.max_by("to_status", "sequence").alias("status"),
        F.max_by(F.when(F.col("event_type") == "review_started", F.col("actor")), F.when(F.col("event_type") == "review_started", F.col("sequence"))).alias("assigned_to"),
        F.max("sequence").alias("version"),
        F.min("occurred_at").alias("created_at"),
        F.max_by("occurred_at", "sequence").alias("updated_at"),
    )


def _per_case():
    return W.partitionBy("case_id").orderBy("sequence")


def audit_transitions(events: DataFrame, allowed=TRANSITIONS) -> DataFrame:
    """(case_id, sequence, problem): steps that no rule allows, changes after the end, wrong stated origins."""
    spark = events.sparkSession
    prev = F.coalesce(F.lag("to_status").over(_per_case()), F.lit(""))
    d = events.select("case_id", "sequence", "event_type", F.coalesce("from_status", F.lit("")).alias("stated"), F.coalesce("to_status", F.lit("")).alias("to_status"), prev.alias("prev"))
    ok = spark.createDataFrame(list(allowed), "prev string, to_status string").withColumn("ok", F.lit(True))
    d = d.join(F.broadcast(ok), ["prev", "to_status"], "left")  # a handful of rows
    problem = (
        F.when(F.col("prev").isin(*TERMINAL), "change_after_terminal")
        .when(F.col("ok").isNull(), "not_allowed")
        .when(F.col("stated") != F.col("prev"), "origin_mismatch")
        .when((F.col("event_type") == "evidence_attached") & (F.col("prev") != "under_review"), "evidence_outside_review")
    )
    return d.select("case_id", "sequence", problem.alias("problem")).where("problem is not null")


def version_conflicts(events: DataFrame) -> DataFrame:
    """Events whose ``expected_version`` isn't the version before them."""
    prev = F.coalesce(F.lag("sequence").over(_per_case()), F.lit(0))
    return events.select("case_id", "sequence", "expected_version", prev.cast("long").alias("actual_version")).where("expected_version <> actual_version")


def event_body(prev: Column) -> Column:
    """The JSON text that an event's hash covers: its twelve fields with sorted keys, the metadata as parsed JSON.

    prev: the previous hash as JSON text.
    """
    text = ("event_id", "case_id", "event_type", "to_status", "actor", "actor_role", "rationale", "occurred_at")
    fields = {c: quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in text}
    return canonical_json(**fields, from_status=quoted(F.col("from_status")), metadata=canonical_text(F.col("metadata_json")), previous_event_hash=prev, sequence=F.col("sequence").cast("string"))


def event_digest(prev: Column) -> Column:
    """The hash that an event should have after ``prev``."""
    return F.sha2(event_body(quoted(prev)), 256)


def verify_chain(events: DataFrame) -> DataFrame:
    """(case_id, sequence, problem): gaps in the numbers, broken links, contents that don't hash to what is stored."""
    w = _per_case()
    d = events.withColumns({"__n": F.row_number().over(w), "__prev": F.coalesce(F.lag("event_hash").over(w), F.lit(""))})
    d = d.withColumn("__own", event_digest(F.coalesce("previous_event_hash", F.lit(""))))
    problem = F.when(F.col("sequence") != F.col("__n"), "sequence_gap").when(F.coalesce("previous_event_hash", F.lit("")) != F.col("__prev"), "broken_link").when(F.coalesce("event_hash", F.lit("")) != F.col("__own"), "content_changed")
    return d.select("case_id", "sequence", problem.alias("problem")).where("problem is not null")


def build_chain(rows: DataFrame, key: str, order: str, head: Column, tail: Column) -> DataFrame:
    """``rows`` with ``previous_event_hash`` ('' for a key's first row) and ``event_hash``, the SHA-256 of head, previous
    hash and tail, in order inside each key; rows of one place go by their tail. Null heads and tails are empty.

    A chain is sequential by definition: a key's rows stream by in order, so that its length costs no memory; keys are
    dealt over tasks. A null key has a chain of its own.
    """
    schema = T.StructType([*rows.schema, T.StructField("previous_event_hash", T.StringType()), T.StructField("event_hash", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, prev = object(), ""
        for batch in batches:
            before, after = [], []
            for k, h, t in zip(*(batch.column(c).to_pylist() for c in ("__key", "__head", "__tail")), strict=True):
                if k != at:
                    at, prev = k, ""
                before.append(prev)
                prev = hashlib.sha256(f"{h}{prev}{t}".encode()).hexdigest()
                after.append(prev)
            yield batch.drop_columns(["__key", "__head", "__tail"]).append_column("previous_event_hash", pa.array(before, pa.string())).append_column("event_hash", pa.array(after, pa.string()))

    none = F.lit("")
    d = rows.withColumns({"__key": F.col(key).cast("string"), "__head": F.coalesce(head, none), "__tail": F.coalesce(tail, none)})
    return d.repartition(n_partitions(rows.sparkSession), "__key").sortWithinPartitions("__key", order, "__tail").mapInArrow(run, schema)


def chain_events(events: DataFrame) -> DataFrame:
    """``events`` with the hashes that a writer stores, each over the one before."""
    mark = "\u0001"  # stands for the previous hash: escaped JSON text has no such character
    parts = F.split(event_body(F.lit(f'"{mark}"')), mark)
    return build_chain(events, "case_id", "sequence", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))


def reconcile(recorded: DataFrame, stored: DataFrame, key: str = "evidence_id", events: DataFrame | None = None) -> DataFrame:
    """(key, problem), a row a problem: entries on one side alone, hashes or sizes that differ from the content.

    stored has the ``content`` itself; null content is none. With ``events`` (key, metadata_json of the evidence events) also: events without
    a record, records without an event, ``<field>_differs`` for each committed field that isn't as recorded, and
    archive receipts that aren't verified (``archive_receipt`` is JSON text).
    """
    s = stored.where("content is not null").select(key, F.sha2(F.col("content").cast("binary"), 256).alias("actual_sha"), F.octet_length("content").cast("long").alias("actual_size"), F.lit(True).alias("__s"))
    d = recorded.withColumn("__r", F.lit(True)).join(s, key, "full_outer")
    both = F.col("__r") & F.col("__s")
    problems = [
        F.when(F.col("__s").isNull() & F.col("__r"), "record_without_content"),
        F.when(F.col("__r").isNull(), "content_without_record"),
        F.when(both & ~F.col("sha256").eqNullSafe(F.col("actual_sha")), "hash_mismatch"),
        F.when(both & ~F.col("byte_size").eqNullSafe(F.col("actual_size")), "size_mismatch"),
    ]
    if events is not None:
        d = d.join(events.select(key, F.col("metadata_json").alias("__meta"), F.lit(True).alias("__e")), key, "full_outer")
        problems += [F.when(F.col("__e") & F.col("__r").isNull(), "event_without_record"), F.when(F.col("__r") & F.col("__e").isNull(), "record_without_event")]
        for c in COMMITTED:
            have = canonical_text(F.col(c)) if c == "archive_receipt" else F.col(c).cast("string")
            told = F.get_json_object("__meta", f"$.{c}")
            told = canonical_text(told) if c == "archive_receipt" else told
            problems.append(F.when(F.col("__e") & F.col("__r") & ~have.eqNullSafe(told), f"{c}_differs"))
        receipt = F.col("archive_receipt")
        problems.append(F.when(F.col("__r") & receipt.isNotNull() & (F.coalesce(F.get_json_object(receipt, "$.verified"), F.lit("")) != "true"), "unverified_receipt"))
    return d.select(key, F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def audit_permissions(events: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(case_id, sequence, problem): roles without the permission that an event needs, actors of another organisation."""
    spark = events.sparkSession
    needs = spark.createDataFrame(list(PERMISSION_OF), "event_type string, permission string")
    grants = spark.createDataFrame([(r, p, True) for r, ps in ROLE_PERMISSIONS.items() for p in ps], "actor_role string, permission string, granted boolean")
    d = events.join(F.broadcast(needs), "event_type", "left").join(F.broadcast(grants), ["actor_role", "permission"], "left")  # fixed lists
    problem = F.when(F.col("granted").isNull(), "not_permitted")
    if cases is not None:
        d = d.join(cases.select("case_id", F.col("organization_id").alias("__org")), "case_id", "left")
        problem = problem.when(F.col("organization_id") != F.col("__org"), "cross_organization")
    return d.select("case_id", "sequence", problem.alias("problem")).where("problem is not null")


def unique_artifacts(artifacts: DataFrame) -> DataFrame:
    """One artifact a (case, type, content hash), the first by id."""
    d = artifacts.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    return d.groupBy("case_id", "evidence_type", "sha256").agg(F.min("evidence_id").alias("evidence_id"), F.count("*").alias("copies"), F.max(F.octet_length("content")).cast("long").alias("byte_size"))


def organization_mismatches(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Cases whose organisation isn't the one committed in their first event."""
    first = events.groupBy("case_id").agg(F.min_by(F.get_json_object("metadata_json", "$.identity.organization_id"), "sequence").alias("committed"))
    return cases.join(first, "case_id", "left").where(~F.col("organization_id").eqNullSafe(F.col("committed"))).select("case_id", "organization_id", "committed")


def feedback_report(cases: DataFrame, events: DataFrame, min_cohort: int = 5) -> DataFrame:
    """Per model version: cases, terminal share, confirmed share and median review hours; small cohorts are blanked. The median is
    exact, over ranges of hours; cases without a version are a cohort without one."""
    begins = F.col("event_type") == "review_started"
    start = F.min_by(F.when(begins, F.col("occurred_at")), F.when(begins, F.col("sequence"))).alias("started")
    ends = F.col("event_type").isin(*TERMINAL)
    done = F.min_by(F.when(ends, F.col("occurred_at")), F.when(ends, F.col("sequence"))).alias("decided")
    per = events.groupBy("case_id").agg(start, done, F.max_by("to_status", "sequence").alias("status"))
    d = cases.select("case_id", "model_version").join(per, "case_id", "left").withColumn("hours", hours_between(F.col("started"), F.col("decided")))
    ended = F.col("status").isin(*TERMINAL)
    g = d.groupBy("model_version").agg(F.count("*").alias("cases"), F.sum(F.when(ended, 1).otherwise(0)).alias("terminal"), F.sum(F.when(F.col("status") == TERMINAL[0], 1).otherwise(0)).alias("confirmed"))
    middle = quantiles(d, "hours", [0.5], ["model_version"]).select(F.col("model_version").alias("__v"), F.col("q")[0].alias("median_hours"))
    g = g.join(middle, F.col("model_version") == F.col("__v"), "left")
    shown = F.col("cases") >= min_cohort
    return g.select("model_version", "cases", (~shown).alias("suppressed"), F.when(shown, F.col("terminal") / F.col("cases")).alias("terminal_rate"), F.when(shown, F.try_divide("confirmed", "terminal")).alias("confirmed_rate"), F.when(shown, F.col("median_hours")).alias("median_hours"))


def list_cases(cases: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """The cases of newest activity, 1 to 200 of them."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    d = cases if status is None else cases.where(F.col("status") == status)
    return d.orderBy(F.desc("updated_at"), "case_id").limit(limit)
