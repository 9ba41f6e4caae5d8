"""Decisions that are only ever appended: checked, superseded, and chained by hashes.

A chain is the decisions of one ``chain`` (a day), in the order of ``seq``.  Each row's hash covers its
content and the hash before it, so a verifier needs only a row and its predecessor, and chains are
extended and verified side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What stands before a chain's first row, and what a decision may say.
GENESIS = "0" * 64
DECISIONS = ["ACCEPT", "REJECT", "OVERRIDE"]
OVERRIDES = ["ACCEPT", "REVIEW", "REJECT", "ESCALATE"]
SOURCES = ["analyst_ui", "import", "backfill", "test_fixture"]
CONTENT = ["decision_id", "event_id", "decision", "override_action", "reason_code", "reason_text", "decided_at", "supersedes", "decision_source"]


def refusals(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """(decision_id, reason): why a decision may not be written; several reasons give several rows.

    ``events`` has event_id.  A null decision_id is a reason of its own.
    """
    known = events.select("event_id", F.lit(True).alias("known")).distinct()
    override = F.col("decision") == "OVERRIDE"
    rules = {
        "no decision id": F.col("decision_id").isNull(),
        "unknown decision": ~F.coalesce(F.col("decision").isin(DECISIONS), F.lit(False)),
        "override without action and reason": override & (F.col("override_action").isNull() | F.col("reason_code").isNull()),
        "unknown override action": override & F.col("override_action").isNotNull() & ~F.col("override_action").isin(OVERRIDES),
        "reason OTHER without text": override & (F.col("reason_code") == "OTHER") & (F.coalesce(F.trim("reason_text"), F.lit("")) == ""),
        "unknown source": ~F.coalesce(F.col("decision_source").isin(SOURCES), F.lit(False)),
        "no such event": F.col("known").isNull(),
    }
    told = F.array_compact(F.array(*[F.when(when, reason) for reason, when in rules.items()]))
    return decisions.join(known, "event_id", "left").select("decision_id", F.explode(told).alias("reason"))


def content(names: list[str] | None = None) -> Column:
    """One text of all that a decision says; a null differs from an empty text."""
    return F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in names or CONTENT]), {"ignoreNullFields": "false"})


def row_hash(prev: Column, text: Column) -> Column:
    return F.sha2(F.concat(prev, text), 256)


def append(ledger: DataFrame | None, decisions: DataFrame) -> DataFrame:
    """The rows to append for ``decisions`` (chain, seq and CONTENT): prev_row_hash and row_hash beside them.

    Each chain goes on from its last row in ``ledger``.  Within a chain the order is seq, then
    decision_id.  A chain's new rows stream through one sorted partition, as each hash needs the last.  They are
    numbered by a window, which no later plan may take apart: after the join a bare ``repartition`` by chain is
    dropped as done already, and adaptive execution then reads the join's shuffle in pieces.
    """
    rows = decisions.withColumn("text", content())
    if ledger is None:
        rows = rows.withColumn("head", F.lit(GENESIS))
    else:
        heads = ledger.groupBy("chain").agg(F.max_by("row_hash", F.struct("seq", "decision_id")).alias("head"))
        rows = rows.join(heads, "chain", "left").withColumn("head", F.coalesce("head", F.lit(GENESIS)))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("chain").orderBy("seq", "decision_id")))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev = None
        for batch in batches:
            before, own = [], []
            for nth, head, text in zip(batch["nth"], batch["head"], batch["text"], strict=True):
                if nth == 1:
                    prev = head
                before.append(prev)
                prev = sha256((prev + text).encode()).hexdigest()
                own.append(prev)
            yield batch.drop(columns=["nth", "head", "text"]).assign(prev_row_hash=before, row_hash=own)

    columns = [c for c in rows.columns if c not in ("nth", "head", "text")]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*columns).dtypes) + ", prev_row_hash string, row_hash string"
    return rows.select(*columns, "nth", "head", "text").mapInPandas(hashed, schema)


def verified(ledger: DataFrame) -> DataFrame:
    """``ledger`` with edited (its hash does not follow from it) and unlinked (it does not name its predecessor's)."""
    before = F.lag("row_hash").over(Window.partitionBy("chain").orderBy("seq", "decision_id"))
    return ledger.withColumns({"edited": ~row_hash(F.col("prev_row_hash"), content()).eqNullSafe(F.col("row_hash")), "unlinked": ~F.col("prev_row_hash").eqNullSafe(F.coalesce(before, F.lit(GENESIS)))})


def current(decisions: DataFrame) -> DataFrame:
    """The decisions that no other one supersedes."""
    gone = decisions.where("supersedes is not null").select(F.col("supersedes").alias("decision_id")).distinct()
    return decisions.join(gone, "decision_id", "left_anti")


def learnable(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """The decisions that labels may come from, beside what ``events`` says of theirs: they stand, an analyst made them, and they judge."""
    rows = current(decisions).where((F.col("decision_source") == "analyst_ui") & ~F.col("reason_code").eqNullSafe("INSUFFICIENT_EVIDENCE_TO_JUDGE"))
    return rows.join(events, "event_id")


def listed(events: DataFrame, decisions: DataFrame, limit: int = 200, decision: str | None = None, **equal: str) -> DataFrame:
    """The newest ``limit`` events with the decision that stands (null: none), after filters.

    ``equal`` names columns of ``events`` (headline, subtype, case_id) and what they must be; ``decision`` is what the standing decision must be, or UNREVIEWED
    for events without one.  Filters on events come before anything is joined, and only the page that is shown is sorted.
    """
    for name, value in equal.items():
        events = events.where(F.col(name) == value)
    stands = current(decisions).groupBy("event_id").agg(F.max_by(F.struct("decision_id", "decision", "override_action", "reason_code", "decided_at"), "decision_id").alias("d")).select("event_id", "d.*")
    newest = lambda rows: rows.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)
    if decision is None:
        events = newest(events)
    rows = events.join(stands, "event_id", "left")
    if decision == "UNREVIEWED":
        rows = newest(rows.where("decision is null"))
    elif decision is not None:
        rows = newest(rows.where(F.col("decision") == decision))
    return rows
