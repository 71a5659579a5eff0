from datetime import datetime, timezone

import pytest

from weftlens.operators.timestamps import normalise_timestamps

SCHEMA = "id int, text string, zone string, day_first boolean, received_at timestamp, format string"


def ms(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000)


CASES = [
    ("2021-04-16 02:50:56 UTC", "Asia/Seoul", True, ms(2021, 4, 16, 2, 50, 56)),
    ("2022-10-01T20:01:39.0819Z", "Asia/Seoul", True, ms(2022, 10, 1, 20, 1, 39) + 81),
    ("1645049620", "UTC", True, 1645049620000),
    ("1645049620006", "UTC", True, 1645049620006),
    ("1721808629284430", "UTC", True, 1721808629284),
    ("/Date(1657703020440+1000)/", "UTC", True, 1657703020440),
    ("2025년 5월 4일 오전 12:03:28", "Asia/Seoul", True, ms(2025, 5, 3, 15, 3, 28)),
    ("2022년 12월 9일 오후 9:50:58", "Asia/Seoul", False, ms(2022, 12, 9, 12, 50, 58)),
    ("2023年6月27日 09:17:07", "Asia/Shanghai", True, ms(2023, 6, 27, 1, 17, 7)),
    ("Wed, 20 Jul 2022 17:26:02 -0700", "UTC", True, ms(2022, 7, 21, 0, 26, 2)),
    ("11.07.2021 02:16", "Europe/Berlin", True, ms(2021, 7, 11, 0, 16)),
    ("3/4/2022 2:07:29 AM", "UTC", False, ms(2022, 3, 4, 2, 7, 29)),
    ("3/4/2022 12:07:29 PM", "UTC", True, ms(2022, 4, 3, 12, 7, 29)),
    ("20210403T165257Z", "Asia/Seoul", True, ms(2021, 4, 3, 16, 52, 57)),
    ("20230907050325", "Australia/Sydney", True, ms(2023, 9, 6, 19, 3, 25)),
    ("20210114", "UTC", True, ms(2021, 1, 14)),
    ("2023-05-19", "America/New_York", True, ms(2023, 5, 19, 4)),
    ("2025-05-29 21:48:46 KST", "UTC", True, ms(2025, 5, 29, 12, 48, 46)),
    ("2024-10-06T04:06:03+11:00[Australia/Sydney]", "UTC", True, ms(2024, 10, 5, 17, 6, 3)),
    # The clock shows 02:30 twice: the earlier counts. It skips 02:30: it moves on by an hour.
    ("2021-10-31 02:30:00", "Europe/Berlin", True, ms(2021, 10, 31, 0, 30)),
    ("2021-03-28 02:30:00", "Europe/Berlin", True, ms(2021, 3, 28, 1, 30)),
    ("30/02/2022 09:15:00", "UTC", True, None), ("2022-13-04T08:00:00", "UTC", True, None), ("2023-06-12 25:71:00", "UTC", True, None), ("12/14/2022 1:00:00 PM", "UTC", True, None),
    ("13:00:00 PM", "UTC", True, None), ("", "UTC", True, None), ("n/a", "UTC", True, None), (None, "UTC", True, None), ("2022-01-01 00:00:00", None, True, None), ("x" * 100_000, "UTC", True, None),
]


@pytest.fixture(scope="module")
def outcome(spark):
    rows = [(i, text, zone, day_first, datetime(2026, 1, 1), "mine") for i, (text, zone, day_first, _) in enumerate(CASES)]
    df = normalise_timestamps(spark.createDataFrame(rows, SCHEMA), "text", "zone", ["zone"], "day_first", "received_at")
    assert {"format", "format_in"} <= set(df.columns)
    return {r["id"]: r for r in df.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_instant(outcome, i):
    assert outcome[i]["epoch_ms"] == CASES[i][3], CASES[i]


def test_order_is_learnt_where_no_hint_is_given(spark):
    clear = [(i, f"{d}/3/2022 10:00:00", "UTC", None, datetime(2026, 1, 1), "") for i, d in enumerate(range(13, 29))]
    rows = [*clear, (99, "4/3/2022 10:00:00", "UTC", None, datetime(2026, 1, 1), "")]
    found = {r["id"]: r for r in normalise_timestamps(spark.createDataFrame(rows, SCHEMA), "text", "zone", ["zone"], "day_first", "received_at").collect()}
    assert found[99]["epoch_ms"] == ms(2022, 3, 4, 10) and not found[99]["ambiguous"]


def test_a_hint_is_weighed_and_not_obeyed(spark):
    """The mixture decides: a word about the order outweighs few values, and an impossible value is none for all that."""
    rows = [(i, f"{d}/3/2022 10:00:00", "UTC", True, datetime(2026, 1, 1), "") for i, d in enumerate(range(13, 29))] + [(50, "4/3/2022 10:00:00", "UTC", True, datetime(2026, 1, 1), ""), (51, "3/14/2022 10:00:00", "UTC", True, datetime(2026, 1, 1), ""), (52, "4/3/2022 10:00:00", "UTC", None, datetime(2026, 1, 1), "")]
    run = lambda **k: {r["id"]: r for r in normalise_timestamps(spark.createDataFrame(rows, SCHEMA), "text", "zone", ["zone"], "day_first", "received_at", **k).collect()}
    found = run()
    assert found[50]["epoch_ms"] == found[52]["epoch_ms"] == ms(2022, 3, 4, 10) and found[51]["epoch_ms"] is None and found[51]["format"] is None and not found[51]["ambiguous"]
    # With a source that is often misled the same value is read in the other order.
    assert run(misled=0.2, unreadable=1e-9)[51]["epoch_ms"] == ms(2022, 3, 14, 10)


def test_shared_abbreviations_are_read_as_their_source_reads_them(spark):
    """CST is China's or America's time by the mixture: here only one of them is not in the future."""
    at = datetime(2022, 3, 4, 12)
    rows = [(i, f"2022-03-05 1{i % 10}:00:00 CST", "UTC", None, at, "") for i in range(9, 19)] + [(99, "2022-03-01 10:00:00 CST", "UTC", None, at, "")]
    found = {r["id"]: r for r in normalise_timestamps(spark.createDataFrame(rows, SCHEMA), "text", "zone", ["zone"], "day_first", "received_at").collect()}
    assert found[99]["format"] == "cst_china" and found[99]["epoch_ms"] == ms(2022, 3, 1, 2)


def test_what_cannot_be_told_is_marked(spark):
    df = spark.createDataFrame([(1, "4/3/2022 10:00:00", "UTC", None, datetime(2026, 1, 1), ""), (1, "4/3/2022 10:00:00", "UTC", None, datetime(2026, 1, 1), "")], SCHEMA)
    rows = normalise_timestamps(df, "text", "zone", ["zone"], "day_first", "received_at").collect()
    assert len(rows) == 2 and all(r["ambiguous"] and r["epoch_ms"] is None for r in rows)


def test_empty(spark):
    assert normalise_timestamps(spark.createDataFrame([], SCHEMA), "text", "zone", ["zone"]).count() == 0
