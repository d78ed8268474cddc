"""Page cache: what is stored, what a lookup finds, and what the scan skips."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadloom.sources import captures

NOON = datetime(2024, 5, 1, 12)
RESPONSES = "url string, status int, text string, ts timestamp, error string"


@pytest.fixture()
def path(session, tmp_path):
    where = str(tmp_path / "cache")
    rows = [("https://a.io/", 200, "old", NOON - timedelta(hours=30), None), ("https://a.io/", 200, "new", NOON, None),
            ("https://b.io/", 503, "down", NOON, None), ("https://c.io/", 200, "", NOON, None),
            ("https://d.io/", 200, "slow", NOON, "timeout"), (None, 200, "none", NOON, None), ("https://e.io/", 200, "x", None, None),
            ("https://f.io/", 204, "tie b", NOON, None), ("https://f.io/", 201, "tie a", NOON, None),
            ("https://g.io/", 200, "é" * 100_000, NOON - timedelta(seconds=86_400), None),
            ("https://h.io/", 200, "late", NOON - timedelta(seconds=86_401), None)]
    captures.put(session.createDataFrame(rows, RESPONSES), where, buckets=8)
    return where


def found(session, path, urls, **options):
    asked = session.createDataFrame([(u, NOON) for u in urls], "url string, now timestamp")
    return {r.url: (r.hit, r.cached_status, r.cached_text) for r in captures.lookup(asked, path, **options).collect()}


@pytest.mark.parametrize("broadcast_keys", [500_000, 0])
def test_lookup(session, path, broadcast_keys):
    urls = [f"https://{c}.io/" for c in "abcdefgh"] + [None]
    got = found(session, path, urls, broadcast_keys=broadcast_keys)
    miss = (False, None, None)
    assert got == {"https://a.io/": (True, 200, "new"), "https://b.io/": miss, "https://c.io/": miss, "https://d.io/": miss,
                   "https://e.io/": miss, "https://f.io/": (True, 201, "tie a"), "https://g.io/": (True, 200, "é" * 100_000),
                   "https://h.io/": miss, None: miss}
    assert found(session, path, ["https://h.io/"], ttl_seconds=0)["https://h.io/"] == (True, 200, "late")


def test_later_captures_replace_and_damaged_bodies_miss(session, path):
    captures.put(session.createDataFrame([("https://a.io/", 200, "newest", NOON - timedelta(hours=1), None)], RESPONSES), path)
    assert found(session, path, ["https://a.io/"])["https://a.io/"] == (True, 200, "newest")
    table = captures.KeyedTable.open(session, path)
    table.upsert(table.rows().where("url = 'https://a.io/'").withColumn("body", F.lit(b"\x1f\x8bnot gzip")))
    assert found(session, path, ["https://a.io/"])["https://a.io/"] == (False, None, None)
    assert "https://a.io/" not in {r.url for r in captures.pages(session, path).collect()}


def test_no_cache_no_requests(session, path, tmp_path):
    assert found(session, str(tmp_path / "nothing"), ["https://a.io/"]) == {"https://a.io/": (False, None, None)}
    assert captures.lookup(session.createDataFrame([], "url string, now timestamp, hits int"), path).count() == 0


def test_filters_reach_the_scan(session, path):
    got = captures.pages(session, path, ["https://a.io/", "https://f.io/", "https://b.io/"], since=NOON - timedelta(hours=2))
    assert {(r.url, r.html) for r in got.collect()} == {("https://a.io/", "new"), ("https://f.io/", "tie a")}
    plan = captures.stored(session, path, ["https://a.io/"], since=NOON)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "EqualTo(url_key" in pushed and "IsNotNull(ts)" in pushed  # the plan text is cut after that
    assert "bucket" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
