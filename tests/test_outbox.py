from gaugeloom.operators import outbox

DAY = 86400


def stand(spark, attempts, recovered=None, channel="mail"):
    ids = sorted({a[0] for a in attempts} | {99})
    deliveries = spark.createDataFrame([(i, channel, 1000) for i in ids], "notification_id long, channel string, created_ts long")
    rows = spark.createDataFrame([(i, channel, *a) for i, *a in attempts], "notification_id long, channel string, attempt int, claimed_ts long, result string, finished_ts long, retry_at long")
    return {r.notification_id: (r.state, r.attempts, r.next_ts, r.delivered_ts) for r in outbox.standing(deliveries, rows, recovered).collect()}


def test_the_last_attempt_decides(spark):
    attempts = [
        (1, 1, 1000, "ok", 1001, None), (2, 1, 1000, "permanent", 1001, None), (3, 1, 1000, "retryable", 1002, None),
        (4, 1, 1000, "retryable", 1002, None), (4, 2, 1032, "retryable", 1040, 5000), (5, 1, 1000, "retryable", 1002, None), (5, 2, 1032, "ok", 1033, None),
        (6, 7, 70_000, "retryable", 70_000, None), (7, 1, 1000, "retryable", 1002, 1000 + DAY + 1),
    ]
    got = stand(spark, attempts)
    assert got[1] == ("delivered", 1, None, 1001) and got[2] == ("failed", 1, None, None) and got[3] == ("pending", 1, 1032, None)
    assert got[4] == ("pending", 2, 5000, None) and got[5] == ("delivered", 2, None, 1033)
    assert got[6][0] == got[7][0] == "failed" and got[99] == ("pending", 0, 1000, None)


def test_a_file_has_no_lifetime(spark):
    assert stand(spark, [(6, 7, 70_000, "retryable", 70_000, None)], channel="file")[6] == ("pending", 7, 91_600, None)


def test_a_crash_between_claim_and_result(spark):
    attempts = [(1, 1, 1000, "retryable", 1001, None), (1, 2, 2000, None, None, None)]
    assert stand(spark, attempts)[1] == ("sending", 2, None, None)
    assert stand(spark, attempts, recovered=1500)[1] == ("sending", 2, None, None)
    assert stand(spark, attempts, recovered=2500)[1] == ("pending", 2, 2000, None)
    # the retry after the restart is one more attempt
    assert stand(spark, [*attempts, (1, 3, 2600, "ok", 2601, None)], recovered=2500)[1] == ("delivered", 3, None, 2601)
