"""The delivery ledger: where each delivery stands after its attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.operators.upkeep import LIFETIME, RETRY

OK, RETRYABLE, PERMANENT = "ok", "retryable", "permanent"


def standing(deliveries: DataFrame, attempts: DataFrame, recovered: int | None = None) -> DataFrame:
    """deliveries: (notification_id, channel, created_ts); attempts: (notification_id, channel, attempt from 1, claimed_ts, result, finished_ts,
    retry_at), the result null from the claim until it is known, retry_at what the receiver asked for.

    A row a delivery: state, attempts, next_ts, delivered_ts. The last attempt decides: 'ok' delivers, 'permanent' fails, 'retryable' waits for
    the next step of the schedule, or longer if the receiver says so; past the lifetime it fails, except on channel 'file'. A claim without a
    result is 'sending'; one from before ``recovered``, the last restart, is due again at its claim's time, as it was lost.
    A delivery without attempts is due when it was created.
    """
    key = ["notification_id", "channel"]
    last = F.max_by(F.struct("attempt", "claimed_ts", "result", "finished_ts", "retry_at"), F.struct("attempt", "claimed_ts")).alias("a")
    rows = deliveries.join(attempts.groupBy(*key).agg(last), key, "left")
    n = F.coalesce("a.attempt", F.lit(0))
    wait = F.element_at(F.array(*map(F.lit, RETRY)), F.least(F.greatest(n, F.lit(1)), F.lit(len(RETRY))).cast("int"))
    next_ts = F.greatest(F.col("a.finished_ts") + wait, F.coalesce("a.retry_at", F.lit(0)))
    late = (F.col("channel") != "file") & (next_ts > F.col("created_ts") + LIFETIME)
    lost = F.col("a.claimed_ts") < recovered if recovered is not None else F.lit(False)
    result = F.col("a.result")
    state = (
        F.when(n == 0, "pending").when(result.isNull(), F.when(lost, "pending").otherwise("sending"))
        .when(result == OK, "delivered").when((result == PERMANENT) | late, "failed").otherwise("pending")
    )
    due = F.when(n == 0, F.col("created_ts")).when(result.isNull(), F.col("a.claimed_ts")).otherwise(next_ts)
    return rows.select(*key, state.alias("state"), n.cast("int").alias("attempts"), F.when(state == "pending", due).alias("next_ts"), F.when(state == "delivered", F.col("a.finished_ts")).alias("delivered_ts"))
