"""Receipt exclusions: match rules, propose new ones, and keep an append-only registry.

Rules, quarantine rows and events are facts that are only ever appended; the state of a rule is its latest event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.hashing import canonical_hash
from tallyspark.functions.keys import attach_one_row
from tallyspark.functions.text import identity_text
from tallyspark.rules import EXCLUDED_PAY_METHODS, EXCLUDED_RECEIPT_TYPES

IDENTITY = ("receipt_no", "source_order_no", "exclusion_kind")
TAIL = "tail_value"  # the unnamed twentieth column of a displaced export row


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def is_shifted(df: DataFrame) -> Column:
    """A row whose cells moved one column to the right: currency empty, a currency text in the rate cell, a tail value."""
    currency, rate, tail = (identity_text(_col(df, c)) for c in ("original_currency", "fx_rate", TAIL))
    return (currency == "") & (rate != "") & rate.rlike(r"幣|\p{L}") & (tail != "")


def observed_amount(df: DataFrame) -> Column:
    value = F.when(is_shifted(df), _col(df, "base_amount")).otherwise(_col(df, "amount"))
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def exclusion_kind(df: DataFrame) -> Column:
    """``receipt_type:x`` or ``payment_method:y``; displaced rows are read one column further. Blank if neither."""
    kind, method, serial = (identity_text(_col(df, c)) for c in ("receipt_type", "pay_method", "pay_serial"))
    shifted = is_shifted(df)

    def named(prefix: str, c: Column) -> Column:
        return F.concat(F.lit(prefix), c)

    return (
        F.when(kind.isin(*EXCLUDED_RECEIPT_TYPES), named("receipt_type:", kind))
        .when(method.isin(*EXCLUDED_PAY_METHODS), named("payment_method:", method))
        .when(shifted & method.isin(*EXCLUDED_RECEIPT_TYPES), named("receipt_type:", method))
        .when(shifted & serial.isin(*EXCLUDED_PAY_METHODS), named("payment_method:", serial))
        .otherwise(F.lit(""))
    )


def with_identity(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "_receipt": identity_text(F.col("receipt_no")),
            "_order": identity_text(F.col("order_id")),
            "_kind": exclusion_kind(df),
            "_observed": observed_amount(df),
            "_shifted": is_shifted(df),
        }
    )


def candidate_id() -> Column:
    return canonical_hash({"receiptNo": F.col("receipt_no"), "sourceOrderNo": F.col("source_order_no"), "exclusionKind": F.col("exclusion_kind")})


def match_rules(main: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """Drop receipts an active rule names exactly; a rule that fits the receipt but not its order or kind collides.

    ``rules`` has ``id``, the identity columns and ``status``. The newest active rule of a receipt counts.
    """
    active = rules.where(F.col("status") == "active").groupBy(F.col("receipt_no").alias("_receipt")).agg(
        F.max_by(F.struct("id", "source_order_no", "exclusion_kind"), "id").alias("_rule")
    )
    marked = with_identity(main).join(active, "_receipt", "left")
    reason = (
        F.when(F.col("_rule").isNull(), F.lit(None).cast("string"))
        .when(F.col("_order") != F.col("_rule.source_order_no"), F.lit("source_order_mismatch"))
        .when(F.col("_kind") != F.col("_rule.exclusion_kind"), F.lit("exclusion_kind_mismatch"))
        .otherwise(F.lit("match"))
    )
    marked = marked.withColumn("_verdict", reason)
    payload = {
        "registryId": F.col("registry_id"),
        "receiptNo": F.col("receipt_no"),
        "sourceOrderNo": F.col("source_order_no"),
        "exclusionKind": F.col("exclusion_kind"),
        "observedAmount": F.col("observed_amount"),
    }
    matches = marked.where(F.col("_verdict") == "match").select(
        F.col("_rule.id").alias("registry_id"),
        F.col("_receipt").alias("receipt_no"),
        F.col("_order").alias("source_order_no"),
        F.col("_kind").alias("exclusion_kind"),
        F.col("_observed").alias("observed_amount"),
    )
    collisions = marked.where(F.col("_verdict").isNotNull() & (F.col("_verdict") != "match"))
    return {
        "kept": marked.where(F.col("_verdict").isNull() | (F.col("_verdict") != "match")).select(*main.columns),
        "matches": matches.withColumn("row_hash", canonical_hash(payload)),
        "collisions": collisions.select(F.col("_rule.id").alias("registry_id"), F.col("_receipt").alias("receipt_no"), F.col("_verdict").alias("reason")),
    }


def _evidence(df: DataFrame, identities: DataFrame, prefix: str, fields: list[str]) -> DataFrame:
    """Per identity: how many rows carry it, aligned or displaced, and the one row that proves it.

    One aligned row proves an identity; displaced copies are tolerated when their amount agrees.
    """
    rows = with_identity(df).join(
        identities.select(*[F.col(c).alias(f"_i_{c}") for c in IDENTITY]),
        (F.col("_receipt") == F.col("_i_receipt_no")) & (F.col("_order") == F.col("_i_source_order_no")) & (F.col("_kind") == F.col("_i_exclusion_kind")),
    )
    present = [f for f in fields if f in df.columns]
    payload = F.to_json(F.struct(*[F.col(f) for f in sorted(present)]), {"ignoreNullFields": "false"})
    aligned = ~F.col("_shifted")
    keys = [F.col("_receipt").alias("receipt_no"), F.col("_order").alias("source_order_no"), F.col("_kind").alias("exclusion_kind")]
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(aligned, 1)).alias("_aligned"),
        # the single row, or the single aligned row
        F.max(F.when(aligned, F.struct(F.col("_observed").alias("amount"), payload.alias("payload")))).alias("_a"),
        F.max(F.struct(F.col("_observed").alias("amount"), payload.alias("payload"))).alias("_any"),
        F.min(F.when(~aligned, F.col("_observed"))).alias("_s_min"),
        F.max(F.when(~aligned, F.col("_observed"))).alias("_s_max"),
    )
    agrees = (F.abs(F.col("_s_min") - F.col("_a.amount")) <= 0.005) & (F.abs(F.col("_s_max") - F.col("_a.amount")) <= 0.005)
    proven = (F.col("_n") == 1) | ((F.col("_aligned") == 1) & agrees)
    row = F.when(F.col("_n") == 1, F.col("_any")).when(F.col("_aligned") == 1, F.col("_a"))
    return stats.select(
        *IDENTITY,
        F.coalesce(proven, F.lit(False)).alias(f"{prefix}_proven"),
        row["payload"].alias(f"{prefix}_payload"),
        row["amount"].alias(f"{prefix}_amount"),
        F.sha2(row["payload"], 256).alias(f"{prefix}_row_hash"),
    )


# Roles kept as evidence of an excluded receipt.
RAW_EVIDENCE = ("receipt_no", "order_id", "receipt_type", "pay_method", "amount", "base_amount", "receipt_time", "operator", "original_currency", "fx_rate", "pay_serial")
PREPARED_EVIDENCE = ("order_id", "receipt_no", "receipt_type", "pay_method", "amount", "unified_date", "branch", "sub_branch", "salesperson", "source_tag")


def proposal(drivers: DataFrame, raw_main: DataFrame, prepared: DataFrame) -> DataFrame:
    """Exclusion candidates behind the drift drivers, each with its evidence.

    A driver names an order through one excluded receipt; every excluded receipt of that order is a candidate. A
    candidate needs one unambiguous raw row and one unambiguous prepared row of one table (``is_tour``).
    """
    named = drivers.select(
        identity_text(F.col("receipt_no")).alias("receipt_no"),
        identity_text(F.col("order_id")).alias("source_order_no"),
        exclusion_kind(drivers).alias("exclusion_kind"),
        F.col("delta_amount").alias("affected_revenue"),
    ).where((F.col("exclusion_kind") != "") & (F.col("receipt_no") != "") & (F.col("source_order_no") != ""))
    orders = named.groupBy("source_order_no").agg(F.max("affected_revenue").alias("affected_revenue"))
    found = with_identity(prepared).where((F.col("_kind") != "") & (F.col("_receipt") != ""))
    found = found.join(orders.select(F.col("source_order_no").alias("_order")), "_order", "left_semi")
    identities = found.groupBy(
        F.col("_receipt").alias("receipt_no"), F.col("_order").alias("source_order_no"), F.col("_kind").alias("exclusion_kind")
    ).agg(F.min("is_tour").alias("_t0"), F.max("is_tour").alias("_t1"))
    raw = _evidence(raw_main, identities, "raw", list(RAW_EVIDENCE))
    prep = _evidence(prepared.drop("is_tour"), identities, "prepared", list(PREPARED_EVIDENCE))
    joined = identities.join(raw, list(IDENTITY), "left").join(prep, list(IDENTITY), "left").join(orders, "source_order_no")
    usable = F.col("raw_proven") & F.col("prepared_proven") & (F.col("_t0") == F.col("_t1"))
    out = joined.select(
        candidate_id().alias("candidate_id"),
        *IDENTITY,
        F.col("raw_amount").alias("observed_amount"),
        "affected_revenue",
        F.when(F.col("_t0"), F.lit("tour_data")).otherwise(F.lit("others_data")).alias("target_table"),
        "raw_payload",
        "raw_row_hash",
        "prepared_payload",
        "prepared_row_hash",
        F.coalesce(usable, F.lit(False)).alias("is_unambiguous"),
    )
    row = {"candidateId": F.col("candidate_id"), "rawRowHash": F.col("raw_row_hash"), "preparedRowHash": F.col("prepared_row_hash")}
    return out.withColumn("row_hash", canonical_hash(row))


def proposal_fingerprint(candidates: DataFrame, context: dict[str, str]) -> DataFrame:
    """One row: whether the proposal stands (all candidates unambiguous), its size and fingerprint.

    Candidates are folded by commutative sums, so their number does not matter.
    """
    h = F.xxhash64("candidate_id", "row_hash")
    fields = {k: F.lit(v) for k, v in context.items()}
    folded = candidates.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.coalesce(F.min("is_unambiguous"), F.lit(False)).alias("stands"),
        F.coalesce(F.sum(h.cast("decimal(20,0)")).cast("string"), F.lit("0")).alias("_sum"),
        F.coalesce(F.bit_xor(h), F.lit(0)).cast("string").alias("_xor"),
    )
    digest = canonical_hash({**fields, "candidates": F.col("candidates"), "rowSum": F.col("_sum"), "rowXor": F.col("_xor")})
    return folded.select("candidates", "stands", F.when(F.col("stands"), digest).alias("fingerprint"))


# --- registry -----------------------------------------------------------------------------------------------
# rules:      id, receipt_no, source_order_no, exclusion_kind, reason, evidence_hash, fingerprint, operation_id, created_by
# quarantine: registry_id, operation_id, target_table, raw_payload, raw_row_hash, prepared_payload, prepared_row_hash, observed_amount
# events:     registry_id, operation_id, event_type, fingerprint, payload, seq
EVENT_TYPES = ("activated", "activation_rejected", "auto_applied", "collision_blocked", "revocation_preview_passed", "revocation_preview_failed", "revoked")


def rule_id() -> Column:
    """Stable id from the identity, so activating the same receipt twice cannot create two rules."""
    return F.xxhash64(*IDENTITY)


def activation(candidates: DataFrame, rules: DataFrame, states: DataFrame, operation_id: str, created_by: str, fingerprint: str) -> dict[str, DataFrame]:
    """Facts to append when candidates are confirmed. Known rules add nothing; revoked ones are reported, not revived."""
    fresh = candidates.dropDuplicates(list(IDENTITY)).withColumn("id", rule_id())
    known = fresh.join(rules.select("id").distinct(), "id", "left_semi")
    revoked = known.join(states.where(F.col("status") == "revoked").select("id"), "id", "left_semi")
    new = fresh.join(rules.select("id").distinct(), "id", "left_anti")
    evidence = {"candidateId": F.col("candidate_id"), "rawRowHash": F.col("raw_row_hash"), "preparedRowHash": F.col("prepared_row_hash")}
    stamp = [F.lit(operation_id).alias("operation_id")]
    return {
        "rules": new.select("id", *IDENTITY, F.lit("confirmed exact excluded receipt").alias("reason"), canonical_hash(evidence).alias("evidence_hash"), F.lit(fingerprint).alias("fingerprint"), *stamp, F.lit(created_by).alias("created_by")),
        "quarantine": new.select(F.col("id").alias("registry_id"), *stamp, "target_table", "raw_payload", "raw_row_hash", "prepared_payload", "prepared_row_hash", "observed_amount"),
        "events": new.select(*event_columns("activated", operation_id, fingerprint, F.to_json(F.struct("candidate_id")))),
        "already_active": known.join(revoked.select("id"), "id", "left_anti").select("id", *IDENTITY),
        "rejected_revoked": revoked.select("id", *IDENTITY),
    }


def event_columns(kind: str, operation_id: str, fingerprint: str, payload: Column, registry: str = "id") -> list[Column]:
    if kind not in EVENT_TYPES:
        raise ValueError(f"unknown event type {kind}")
    return [
        F.col(registry).alias("registry_id"),
        F.lit(operation_id).alias("operation_id"),
        F.lit(kind).alias("event_type"),
        F.lit(fingerprint).alias("fingerprint"),
        payload.alias("payload"),
    ]


def new_events(events: DataFrame, existing: DataFrame) -> DataFrame:
    """Events not yet recorded under the same operation, rule, type and fingerprint."""
    keys = ["operation_id", "registry_id", "event_type", "fingerprint"]
    return events.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def rule_states(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Rules with their current status: revoked once any revocation is recorded, and it stays so."""
    per_rule = events.groupBy(F.col("registry_id").alias("id")).agg(
        F.count(F.lit(1)).alias("event_count"), F.max((F.col("event_type") == "revoked").cast("int")).alias("_revoked")
    )
    joined = rules.join(per_rule, "id", "left")
    status = F.when(F.coalesce("_revoked", F.lit(0)) == 1, F.lit("revoked")).otherwise(F.lit("active"))
    return joined.withColumns({"status": status, "event_count": F.coalesce("event_count", F.lit(0))}).drop("_revoked")


def registry_revision(states: DataFrame) -> DataFrame:
    """A print of the active rule set; any change of it changes the print."""
    active = states.where(F.col("status") == "active")
    h = F.xxhash64("id", *IDENTITY)
    folded = active.agg(F.count(F.lit(1)).alias("active_rules"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("_s"), F.bit_xor(h).cast("string").alias("_x"))
    return folded.select("active_rules", F.sha2(F.concat_ws("|", "active_rules", "_s", "_x"), 256).alias("revision"))


def status_counts(states: DataFrame) -> DataFrame:
    return states.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("active", "revoked")])


def list_rules(states: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Rules in identity order, all of them or a page of ``limit``."""
    if status not in (None, "active", "revoked"):
        raise ValueError("status is active, revoked or none")
    rows = states if status is None else states.where(F.col("status") == status)
    rows = rows.orderBy(*IDENTITY, "id")
    return rows if limit is None else rows.limit(max(1, int(limit)))


def read_model(rules: DataFrame, events: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    states = rule_states(rules, events)
    return {
        "active": list_rules(states, "active", limit),
        "revoked": list_rules(states, "revoked", limit),
        "counts": status_counts(states),
        "revision": registry_revision(states),
    }


def first_evidence(quarantine: DataFrame, rules: DataFrame) -> DataFrame:
    """The earliest quarantine row of each rule with the rule's evidence hash."""
    rest = [c for c in quarantine.columns if c not in ("registry_id", "seq")]
    first = quarantine.groupBy("registry_id").agg(F.min_by(F.struct(*rest), "seq").alias("q"))
    return first.join(rules.select(F.col("id").alias("registry_id"), "evidence_hash"), "registry_id").select("registry_id", "q.*", "evidence_hash")


def revocation(states: DataFrame, rule: int, operation_id: str, revoked_by: str, fingerprint: str) -> DataFrame:
    """The event that revokes an active rule; empty if there is no such active rule."""
    target = states.where((F.col("id") == rule) & (F.col("status") == "active"))
    payload = F.to_json(F.struct(F.col("id").alias("ruleId"), F.lit(revoked_by).alias("revokedBy")))
    return target.select(*event_columns("revoked", operation_id, fingerprint, payload))


def restored_receipts(evidence: DataFrame, schema: str) -> DataFrame:
    """Quarantined receipts back as rows, from their stored payload."""
    return evidence.select(F.from_json("prepared_payload", schema).alias("p"), "target_table").select("p.*", "target_table")


def with_revision(df: DataFrame, states: DataFrame) -> DataFrame:
    return attach_one_row(df, registry_revision(states).select("revision"))
