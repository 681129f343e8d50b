"""Quota against a request-by-request simulation; ledger; streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import ledger, quota, validate
from docmill.settings import DEFAULT_RULES, Settings
from docmill.streaming.ingest import start_ingest
from docmill.streaming.quota import start_quota
from docmill.streaming.storage import fresh_folder
from docmill.sources.documents import stream_files, with_job_id

SCHEMA = "event_id bigint, ts timestamp, client_id string"
START = dt.datetime(2026, 1, 1, 23, 57)


def make_requests(n: int, seed: int) -> list[tuple]:
    """Requests over a midnight; one client sends a third of them, with equal times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = "hot" if rng.random() < 0.34 else f"c{rng.randint(0, 3)}"
        rows.append((i, START + dt.timedelta(seconds=rng.randint(0, 420)), client))
    return rows


def simulate(rows: list[tuple], per_minute: int, per_day: int) -> dict:
    minutes, days, out = {}, {}, {}
    for event, ts, client in sorted(rows, key=lambda r: (r[1], r[0])):
        second = int(ts.replace(tzinfo=dt.timezone.utc).timestamp())
        minute, day = (client, second // 60), second // 86400
        if per_day and days.get(day, 0) >= per_day:
            out[event] = ("reject", "day", 86400 - second % 86400)
        elif per_minute and minutes.get(minute, 0) >= per_minute:
            out[event] = ("reject", "minute", 60 - second % 60)
        else:
            minutes[minute] = minutes.get(minute, 0) + 1
            days[day] = days.get(day, 0) + 1
            out[event] = ("accept", None, None)
    return out


def decisions(df) -> dict:
    return {r.event_id: (r.decision, r.reason, r.retry_after) for r in df.collect()}


@pytest.mark.parametrize("caps", [(3, 40), (0, 25), (5, 0), (0, 0), (2, 10_000)])
@pytest.mark.parametrize("rank_limit", [1000, 1])
def test_matches_simulation(spark, monkeypatch, caps, rank_limit):
    monkeypatch.setattr(quota, "RANK_LIMIT", rank_limit)
    rows = make_requests(600, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = decisions(quota.decide(df, Settings(quota_per_minute=caps[0], quota_per_day=caps[1])))
    assert got == simulate(rows, *caps)


def test_switched_off(spark):
    df = spark.createDataFrame(make_requests(50, 1), SCHEMA)
    out = quota.decide(df, Settings(quota_enabled=False, quota_per_minute=1))
    assert {r.decision for r in out.collect()} == {"accept"}


def test_hot_group_is_pruned_before_the_shuffle(spark, capsys):
    df = spark.createDataFrame(make_requests(10, 1), SCHEMA)
    quota.decide(df, Settings()).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_one_hot_second(spark, monkeypatch):
    """More requests in one second, some of one microsecond, than a large cap allows."""
    monkeypatch.setattr(quota, "RANK_LIMIT", 3)
    start = dt.datetime(2026, 1, 1, 10, 0, 0)
    rows = [(i, start + dt.timedelta(microseconds=(i % 7) // 2), "c") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for minute, day in ((100, 0), (0, 77), (200, 150)):
        out = quota.decide(df, Settings(quota_per_minute=minute, quota_per_day=day))
        ordered = sorted(out.collect(), key=lambda r: (r[1], r[0]))
        allowed = min(x for x in (minute, day) if x)
        assert [r.decision for r in ordered] == ["accept"] * allowed + ["reject"] * (300 - allowed)


def test_both_cutoffs_share_a_scan(spark, tmp_path):
    rows = spark.createDataFrame(make_requests(50, 2), SCHEMA)
    rows.write.parquet(str(tmp_path / "r"))
    out = quota.decide(spark.read.parquet(str(tmp_path / "r")), Settings(quota_per_minute=2, quota_per_day=9))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") - final.count("ReusedExchange") <= 2


@pytest.mark.parametrize("rank_limit", [1000, 1])
def test_stream_equals_batch(spark, tmp_path, monkeypatch, rank_limit):
    monkeypatch.setattr(quota, "RANK_LIMIT", rank_limit)
    rows = sorted(make_requests(300, 3), key=lambda r: (r[1], r[0]))
    folder, landing = fresh_folder(spark, "quota"), str(tmp_path / "in")
    settings = Settings(quota_per_minute=3, quota_per_day=35)
    for part in range(3):
        chunk = spark.createDataFrame(rows[part * 100 : part * 100 + 100], SCHEMA).coalesce(1)
        chunk.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(SCHEMA).parquet(landing)
        start_quota(stream, folder, settings).awaitTermination()
    got = decisions(spark.read.parquet(f"{folder}/decisions"))
    assert got == simulate(rows, 3, 35)
    last = spark.read.parquet(f"{folder}/minute/batch_id=2")
    assert last.select("_minute").distinct().count() <= 1
    assert spark.read.parquet(f"{folder}/day/batch_id=2").count() == 1


def test_whitelist_table(spark, capsys):
    names = ["Acme Corp", "The ACME corp Ltd", "Globe", "Globex SA", "", None, "x"]
    vendors = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, vendor string")
    listed = spark.createDataFrame([("acme CORP",), ("Globex",), ("Globex",)], "entry string")
    out = validate.vendors_off_list(vendors, listed, "vendor", "entry")
    assert sorted(r.i for r in out.collect()) == [2, 4, 5, 6]
    out.explain()
    assert "NestedLoop" not in capsys.readouterr().out
    none = validate.vendors_off_list(vendors, listed.limit(0), "vendor", "entry")
    assert none.count() == len(names)


def test_ledger(spark):
    t = [dt.datetime(2026, 1, 1, 0, 0, i) for i in range(4)]
    moves = spark.createDataFrame(
        [
            ("a", "a.txt", "queued", None, 1, t[0]),
            ("a", "a.txt", "completed", "{}", 3, t[1]),
            ("a", "a.txt", "running", None, 2, t[1]),
            ("b", "b.txt", "queued", None, 1, t[2]),
        ],
        "job_id string, filename string, status string, result string, seq bigint,"
        " updated_at timestamp",
    )
    jobs = ledger.latest(moves)
    assert {r.job_id: (r.status, r.result) for r in jobs.collect()} == {
        "a": ("completed", "{}"), "b": ("queued", None),
    }
    asked = spark.createDataFrame([("a",), ("b",), ("z",)], "job_id string")
    answers = {r.job_id: r.answer for r in ledger.lookup(asked, jobs).collect()}
    assert answers == {"a": "ready", "b": "processing", "z": "unknown"}
    assert {r.status: r.jobs for r in ledger.status_counts(jobs).collect()} == {
        "completed": 1, "queued": 1,
    }


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    text = "INVOICE\nVendor: Globex\nInvoice #: 1\nDate: 2026-01-15\nTotal: $5.00\n"
    (landing / "a.txt").write_text(text)
    (landing / "b.exe").write_text("x")
    folder = fresh_folder(spark, "ingest")

    def run():
        files = with_job_id(stream_files(spark, str(landing)))
        start_ingest(files, folder, DEFAULT_RULES, as_of=dt.date(2026, 6, 1)).awaitTermination()
        return spark.read.parquet(f"{folder}/results").count()

    assert run() == 1
    (landing / "c.txt").write_text(text + "1 x Bad @ $1..2 = $3\n")
    assert run() == 2
    rows = spark.read.parquet(f"{folder}/results").select("status", "route").collect()
    assert {tuple(r) for r in rows} == {("completed", "auto_approve"), ("failed", None)}
    assert spark.read.parquet(f"{folder}/quarantine").count() == 1
    moves = spark.read.parquet(f"{folder}/transitions")
    asked = moves.select("job_id").distinct().union(spark.createDataFrame([("z",)], "job_id string"))
    answers = ledger.lookup(asked, ledger.latest(moves)).collect()
    assert sorted((r.answer, r.status, r.document_type, r.route, r.error is None) for r in answers if r.status) == [
        ("ready", "completed", "invoice", "auto_approve", True), ("ready", "failed", "unknown", None, False),
    ]
    assert [(r.answer, r.document_type) for r in answers if not r.status] == [("unknown", None)]
    assert moves.groupBy("job_id").count().where(F.col("count") == 3).count() == 2
