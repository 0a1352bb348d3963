"""Login lockout and refresh-token reuse, replayed over event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.replay import replay
from marginalia.functions.skew import previous_by_bucket, running_sum

MAX_ATTEMPTS = 5
LOCK_SECONDS = 900
GRACE_SECONDS = 10
LOCKS = "tenant_id string, email string, locked_at timestamp_ntz, unlock_at timestamp_ntz, failures int, refused long"
REVOCATIONS = "family string, revoked_at timestamp_ntz, reason string, rotations long"


def lockouts(attempts: DataFrame) -> DataFrame:
    """Locks per (tenant, email): when, until when, and how many attempts were refused meanwhile.

    Five failures lock; every failure restarts the 900 s after which the count is forgotten; a success
    clears it; attempts during a lock are refused before the password is looked at and change nothing.
    After 900 s without any attempt nothing is remembered, so an account's log is cut there and the
    pieces are replayed independently, each row by row with three numbers of state. A piece with fewer
    than five failures cannot lock and is left out.
    """
    key = ["tenant_id", "email"]
    order = [F.col("ts"), F.col("event_id")]
    bucket = F.date_trunc("hour", "ts")
    seen = previous_by_bucket(attempts, key, bucket, order, F.col("ts"), "_prev")
    quiet = F.col("_prev").isNull() | (F.col("ts") >= F.col("_prev") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(LOCK_SECONDS)))
    cut = running_sum(seen, key, bucket, order, quiet.cast("int"), "piece")
    failures = F.count_if(~F.col("ok"))
    risky = cut.groupBy(*key, "piece").agg(failures.alias("_f")).filter(F.col("_f") >= MAX_ATTEMPTS)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*key, "piece")]
    kept = cut.join(risky.select(*[F.col(k).alias(f"_k_{k}") for k in (*key, "piece")]), same, "left_semi")
    return replay(kept.drop("_prev"), [*key, "piece"], ["ts", "event_id"], Logins, LOCKS)


class Logins:
    """State of one account: failures counted, until when they are remembered, the running lock."""

    def __init__(self, key: tuple):
        self.tenant, self.email = key[0], key[1]
        self.count, self.until, self.lock = 0, None, None

    def row(self, event) -> Iterator[tuple]:
        if self.until is not None and event.ts >= self.until:
            yield from self.end()
            self.count, self.until, self.lock = 0, None, None
        if self.lock is not None:
            self.lock[-1] += 1
        elif event.ok:
            self.count, self.until = 0, None
        else:
            self.count, self.until = self.count + 1, event.ts + pd.Timedelta(seconds=LOCK_SECONDS)
            if self.count >= MAX_ATTEMPTS:
                self.lock = [self.tenant, self.email, event.ts, self.until, self.count, 0]

    def end(self) -> Iterator[tuple]:
        if self.lock is not None:
            yield tuple(self.lock)


def token_reuse(events: DataFrame) -> DataFrame:
    """Families revoked because a superseded refresh token came back after its grace time.

    ``events``: family, ts, event_id, presented, issued. A presented current token rotates to the issued
    one; a token rotated less than 10 s ago is answered with its successor; anything else ends the family.
    A family that always presents the token issued just before cannot be revoked and is left out.
    """
    wanted = events.select("family", "ts", "event_id", "presented", "issued")
    order = [F.col("ts"), F.col("event_id")]
    seen = previous_by_bucket(wanted, ["family"], F.date_trunc("hour", "ts"), order, F.struct("issued"), "_prev")
    odd = F.col("_prev").isNotNull() & ~F.col("presented").eqNullSafe(F.col("_prev.issued"))
    suspect = seen.filter(odd).select(F.col("family").alias("_family")).distinct()
    wanted = wanted.join(suspect, F.col("family").eqNullSafe(F.col("_family")), "left_semi")
    return replay(wanted, ["family"], ["ts", "event_id"], _Family, REVOCATIONS)


class _Family:
    """State of one token family: the current token, those rotated within the grace time, rotations."""

    def __init__(self, key: tuple):
        self.family, self.current, self.revoked = key[0], None, None
        self.recent, self.rotations = {}, 0

    def row(self, event) -> Iterator[tuple]:
        if self.revoked is None:
            grace = pd.Timedelta(seconds=GRACE_SECONDS)
            self.recent = {jti: at for jti, at in self.recent.items() if event.ts - at <= grace}
            if self.current is None or event.presented == self.current:
                self.recent[event.presented] = event.ts
                self.current, self.rotations = event.issued, self.rotations + 1
            elif event.presented not in self.recent:
                self.revoked = event.ts
        return iter(())

    def end(self) -> Iterator[tuple]:
        if self.revoked is not None:
            yield (self.family, self.revoked, "reuse", self.rotations)
