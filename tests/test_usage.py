import datetime as dt

from giftlens.operators import usage as U

T0 = dt.datetime(2024, 1, 30, 12, 0, 0)


def _log(spark, rows):
    return spark.createDataFrame(rows, "id long, user_id long, date_time timestamp_ntz, api_route string, "
                                       "request_payload string, response_payload string, "
                                       "response_status_code int, response_time_ms double, error_message string")


def test_payload_preview_and_bad_json(spark):
    big = '{"k": "' + "x" * 600 + '"}'
    log = _log(spark, [(1, 1, T0, "/a", big, '{"a": 1}', 200, 1.0, None),
                       (2, 1, T0, "/a", "not json", "", 500, 2.0, "boom")])
    users = spark.createDataFrame([(1, "u1")], "id long, username string")
    rows = {r.id: r for r in U.recent_logs(log, users, limit=10).collect()}
    assert rows[1].request_payload is None and rows[1].response_payload == '{"a":1}'
    assert rows[2].request_payload is None and rows[2].response_payload is None
    err = U.recent_errors(log, users).collect()
    assert [(r.id, r.request_payload) for r in err] == [(2, "not json")]


def test_top_users_ties_break_on_user_id(spark):
    rows = [(i, u, T0, "/a", None, None, 200, 1.0, None) for i, u in enumerate([3, 3, 1, 1, 2])]
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, username string")
    top = [(r.user_id, r.call_count) for r in U.top_users(_log(spark, rows), users, "2024-01-31", k=2).collect()]
    assert top == [(1, 2), (3, 2)]


def test_windows_and_stats(spark):
    rows = [(1, 1, T0, "/a", None, None, 200, 10.0, None),
            (2, 1, T0 - dt.timedelta(days=2), "/b", None, None, 404, 20.0, None),
            (3, 2, T0, "/a", None, None, 503, 30.0, None)]
    log = _log(spark, rows)
    s = U.system_api_stats(log, "2024-01-31 00:00:00", hours=24).first()
    assert (s.total_calls, s.active_users, s.error_count, s.server_error_count) == (2, 2, 1, 1)
    assert s.avg_response_time == 20.0
    per = {r.user_id: r for r in U.user_api_stats(log, "2024-01-31", days=30).collect()}
    assert per[1].unique_endpoints == 2 and per[1].error_count == 1
    rep = U.retention_report(log, "date_time", "2024-01-31", days=1).first()
    assert (rep.kept, rep.deleted) == (2, 1)
