"""Review commands on the history of events, their outcome, and the outbox of what has to be worked out again.

A history is a fold: observations and commands of one event identity in order, each against the head that those before it left. A command
names the head that its reviewer saw, version and state, and is refused where the head has moved since.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..streaming import incremental as inc

#: Commands, and the states of a head.
COMMANDS = ("resolve_parent", "reject_parent", "resolve_conflict", "apply_correction")
STATES = ("effective", "withheld_parent", "withheld_conflict", "rejected", "corrected")
OUTCOME = "status string, refusal string, version long, state string, decision_kind string, reason string, hash string, parent string, invalidates array<string>"


@dataclass
class Head:
    """What is decided of one identity: effective parents are those that a change invalidates."""

    version: int = 0
    state: str | None = None
    hash: str | None = None
    parent: str | None = None
    seen: tuple[str | None, str | None] = (None, None)  # association and parent of the last observation
    variants: set[str] = field(default_factory=set)

    def decide(self, state: str, hash_: str | None, parent: str | None, kind: str, reason: str) -> dict:
        before = self.parent if self.state in ("effective", "corrected") else None
        now = parent if state in ("effective", "corrected") else None
        self.version, self.state, self.hash, self.parent = self.version + 1, state, hash_, parent
        return {"status": "written", "decision_kind": kind, "reason": reason, "invalidates": sorted({p for p in (before, now) if p is not None})}

    def observe(self, hash_: str | None, association: str, parent: str | None) -> dict:
        """A variant that is known, with the parent as it was, changes nothing; a second variant withholds the event until a conflict is resolved."""
        if self.version and hash_ in self.variants and (association, parent) == self.seen:
            return {"status": "unchanged"}
        self.variants.add(hash_)
        self.seen = (association, parent)
        if association == "ambiguous" or len(self.variants) > 1:
            return self.decide("withheld_conflict", hash_, parent, "variant", "conflict")
        if association == "selected_active":
            return self.decide("effective", hash_, parent, "accepted", "observed")
        return self.decide("withheld_parent", hash_, parent, "parent", "observed")

    def command(self, kind: str, expected_version: int | None, expected_state: str | None, variant: str | None, association: str | None, parent: str | None) -> dict:
        refusal = (
            "no_head" if not self.version else "stale_version" if expected_version != self.version else "stale_state" if expected_state != self.state
            else "unknown_command" if kind not in COMMANDS else "unknown_variant" if variant is not None and variant not in self.variants
            else "not_withheld" if kind != "apply_correction" and self.state not in ("withheld_parent", "withheld_conflict")
            else "parent_not_active" if kind == "apply_correction" and association != "selected_active" else None
        )
        if refusal:
            return {"status": "refused", "refusal": refusal}
        hash_ = variant or self.hash
        if kind == "reject_parent":
            return self.decide("rejected", hash_, parent, "parent", "rejection")
        if kind == "apply_correction":
            return self.decide("corrected", hash_, parent, "correction", "correction")
        if kind == "resolve_conflict":
            done = association == "selected_active"
            return self.decide("effective" if done else "rejected", hash_, parent, "accepted" if done else "variant", "conflict_resolved" if done else "rejection")
        state = {"selected_active": "effective", "ambiguous": "withheld_conflict"}.get(association, "withheld_parent")
        return self.decide(state, hash_, parent, {"effective": "accepted", "withheld_conflict": "variant"}.get(state, "parent"), "parent_changed")


def folded(rows: DataFrame) -> DataFrame:
    """rows (identity, moment, seq, kind, hash, association, parent, expected_version, expected_state) to identity, seq, kind and the outcome of each.

    kind is observed or a command. Rows of an identity lie in one partition in order of moment and seq, and are passed on one by
    one with the head alone, so a long history takes no memory. A null identity is an identity of its own. Rows equal in moment and seq are taken by
    kind, hash and parent.
    """
    names = ["identity", "seq", "kind", "hash", "association", "parent", "expected_version", "expected_state"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: object = run  # no identity
        head = Head()
        for frame in frames:
            out = []
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                if row.identity != last:
                    last, head = row.identity, Head()
                if row.kind == "observed":
                    done = head.observe(row.hash, row.association, row.parent)
                else:
                    done = head.command(row.kind, row.expected_version, row.expected_state, row.hash, row.association, row.parent)
                out.append((row.identity, row.seq, row.kind, done["status"], done.get("refusal"), head.version, head.state, done.get("decision_kind"), done.get("reason"), head.hash, head.parent, done.get("invalidates", [])))
            yield pd.DataFrame(out, columns=["identity", "seq", "kind", "status", "refusal", "version", "state", "decision_kind", "reason", "hash", "parent", "invalidates"])

    order = ["identity", "moment", "seq", "kind", "hash", "parent"]
    return rows.repartition("identity").sortWithinPartitions(*order).select(*names).mapInPandas(run, f"identity string, seq long, kind string, {OUTCOME}")


def outbox(outcomes: DataFrame) -> DataFrame:
    """(intent_id, identity, version, parent, reason): one intent for each parent that a written decision invalidates.

    intent_id is a digest of the rest, so a decision that is published again publishes the same intents.
    """
    rows = outcomes.where("status = 'written'").select("identity", "version", F.explode("invalidates").alias("parent"), "reason")
    ident = F.sha2(F.concat_ws("\x1f", F.coalesce("identity", F.lit("\x00")), F.col("version").cast("string"), "parent"), 256)
    return rows.select(ident.alias("intent_id"), "identity", "version", "parent", "reason")


def publish(intents: DataFrame, path: str, commit: int) -> None:
    """Writes the intents of a commit to the change table; a commit that is written again replaces itself."""
    intents.write.mode("overwrite").parquet(f"{path}/commit={commit}")


def consume(spark: SparkSession, path: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads what commits have brought since the last run, and applies each intent once, however often it was published."""
    stream = spark.readStream.schema("intent_id string, identity string, version long, parent string, reason string").parquet(f"{path}/commit=*")
    return inc.ingest(stream, target, checkpoint, ("intent_id",))
