"""A dual token bucket: requests and tokens per minute, reserve first, wait after, settle with what it took."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS, LONGEST = 8, 60.0


class Limiter:
    """Both buckets hold a minute at most. A request larger than a bucket takes all of it."""

    def __init__(self, rpm: float, tpm: float, clock: Callable[[], float] = time.monotonic):
        self.rate = {"requests": rpm / 60, "tokens": tpm / 60}
        self.size = {"requests": float(rpm), "tokens": float(tpm)}
        self.have = dict(self.size)
        self.clock, self.at = clock, clock()

    def _fill(self) -> None:
        now = self.clock()
        for k in self.have:
            self.have[k] = min(self.size[k], self.have[k] + (now - self.at) * self.rate[k])
        self.at = now

    def reserve(self, tokens: float) -> float:
        """Takes one request and its tokens; returns the seconds to wait before sending."""
        self._fill()
        self.have["requests"] -= 1
        self.have["tokens"] -= min(tokens, self.size["tokens"])
        return max(0.0, *(-v / self.rate[k] for k, v in self.have.items() if self.rate[k]))

    def settle(self, reserved: float, actual: float) -> None:
        self.have["tokens"] += min(reserved, self.size["tokens"]) - actual


def retried(call: Callable[[], tuple[int, dict, object]], sleep: Callable[[float], None] = time.sleep, draw: Callable[[float, float], float] = random.uniform):
    """Calls until the status is none of 0, 429, 5xx, eight times at most; waits the longer of Retry-After and a random backoff."""
    status, headers, body = 0, {}, None
    for n in range(ATTEMPTS):
        status, headers, body = call()
        if not (status in (0, 429) or 500 <= status < 600):
            break
        if n + 1 < ATTEMPTS:
            sleep(max(float(headers.get("Retry-After", 0) or 0), draw(0, min(LONGEST, 2.0**n))))
    return status, body


def waits(events: DataFrame, rate: float = 1 / 60, burst: float = 3.0) -> DataFrame:
    """Each user's events through a bucket of `burst` requests that fills at `rate` a second -> event_id, user_id, wait in seconds.

    With reserve-first buckets the balance after n events is a running sum and a running maximum, so windows do:
    the event's balance is its fill level less what came before, clipped at the burst."""
    from pyspark.sql import Window as W

    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = events.select("event_id", "user_id", "ts", t.alias("t"), F.row_number().over(by).alias("n"))
    # balance before the event: min over j <= n of (burst, burst + rate * (t_n - t_j) - (n - j)) = burst + (rate t_n - n) - max_j (rate t_j - j)
    drift = F.lit(rate) * F.col("t") - F.col("n")
    rows = rows.withColumn("drift", drift).withColumn("top", F.max("drift").over(upto))
    after = F.lit(burst) + F.col("drift") - F.col("top") - 1
    return rows.select("event_id", "user_id", F.round(F.greatest(F.lit(0.0), -after / F.lit(rate)), 3).alias("wait"))


def waits_with_state(stream: DataFrame, rate: float = 1 / 60, burst: float = 3.0) -> DataFrame:
    """The same over a stream (event_id, user_id, ts), with the bucket of each user as state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        have, at = state.get if state.exists else (burst, None)
        out = []
        for pdf in batches:
            for e, ts in pdf.sort_values(["ts", "event_id"])[["event_id", "ts"]].itertuples(index=False):
                now = ts.timestamp()
                have = burst if at is None else min(burst, have + max(0.0, now - at) * rate)
                at, have = now, have - 1
                out.append((e, key[0], round(max(0.0, -have / rate), 3)))
        state.update((have, at))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "wait"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, wait double", "have double, at double", "append", GroupStateTimeout.NoTimeout)


WAIT_SQL = """
with r as (select event_id, user_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
d as (select *, t * (1.0::double / 60) - n as drift from r)
select event_id, user_id, round(greatest(0.0, -(3.0 + drift - max(drift) over (partition by user_id order by n rows unbounded preceding) - 1) / (1.0::double / 60)), 3) as wait from d"""
