"""Keyed tables, sitemap recursion and the stored page corpus."""

import glob
import random

import pytest

from leadloom.keyed import KeyedTable, upsert_or_create
from leadloom.sources.tables import sitemap_edges, sitemap_pages


def files(path):
    return {f: f.split("bucket=")[1].split("/")[0] for f in glob.glob(f"{path}/rows/*/*.parquet")}


# ---- keyed tables ------------------------------------------------------------------------------
COLUMNS = "k long, j string, v int"


def test_an_upsert_rewrites_only_touched_buckets(session, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"j{i % 3}", i) for i in range(500)]
    table = KeyedTable.create(session.createDataFrame(rows, COLUMNS), path, ["k", "j"], buckets=16)
    before = files(path)
    batch = [(7, "j1", -7), (8, "other", 8), (900, None, 1)]
    table.upsert(session.createDataFrame(batch, COLUMNS))
    after = files(path)
    touched = {str(r[0]) for r in session.createDataFrame(batch, COLUMNS).select(table._bucket()).collect()}
    assert 0 < len(touched) <= 3
    assert {f for f, b in before.items() if b not in touched} == {f for f, b in after.items() if b not in touched}
    assert not {f for f, b in before.items() if b in touched} & set(after)
    want = {(k, j): v for k, j, v in rows} | {(k, j): v for k, j, v in batch}
    assert {(r.k, r.j): r.v for r in KeyedTable.open(session, path).rows().collect()} == want
    assert table.rows().count() == len(want)
    found = table.of_keys(session.createDataFrame([(7, "j1"), (1000, "x")], "k long, j string"))
    assert [tuple(r) for r in found.collect()] == [(7, "j1", -7)]


def test_many_upserts_equal_the_last_row_of_each_key(session, tmp_path):
    rng, want, path = random.Random(5), {}, str(tmp_path / "t")
    for n in range(5):
        batch = {(rng.randrange(60), f"j{rng.randrange(3)}"): rng.randrange(1000) for _ in range(40 if n else 0)}
        want |= batch
        upsert_or_create(session.createDataFrame([(*k, v) for k, v in batch.items()], COLUMNS), path, ["k", "j"], 4)
    assert {(r.k, r.j): r.v for r in KeyedTable.open(session, path).rows().collect()} == want
    with pytest.raises(ValueError):
        KeyedTable.create(session.createDataFrame([], COLUMNS), path, ["k"])


def test_an_applied_snapshot_keeps_what_it_does_not_name(session, tmp_path):
    old = session.createDataFrame([(i, f"n{i}", 1, f"uid{i}") for i in range(40)], "id long, name string, generation int, uid string")
    table = KeyedTable.create(old, str(tmp_path / "t"), ["id"], buckets=8)
    new = session.createDataFrame([(3, "n3", "x"), (4, "renamed", "x"), (99, "new", "fresh")], "id long, name string, uid string")
    actions = {r.id: (r.action, r.generation) for r in table.apply(new, ["name"], ["uid"]).collect()}
    assert actions == {3: ("unchanged", 1), 4: ("configured", 2), 99: ("created", 1)}
    rows = {r.id: (r.name, r.generation, r.uid) for r in table.rows().collect()}
    assert len(rows) == 41 and rows[4] == ("renamed", 2, "uid4") and rows[99] == ("new", 1, "fresh") and rows[5] == ("n5", 1, "uid5")


# ---- sitemaps ----------------------------------------------------------------------------------
SPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def index(*locs):
    return f"<sitemapindex {SPACE}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def pages_of(*locs):
    return f"<urlset {SPACE}>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"


MAPS = [
    ("a", 200, index("b", "a", "gone", "c")), ("b", 200, index("d", "d")), ("c", 200, pages_of("c1", "c2")), ("d", 200, pages_of("d1")),
    ("deep", 200, index("a")), ("broken", 200, "<urlset"), ("empty", 200, ""), ("null", 200, None), ("failed", 404, pages_of("no")),
    ("twice", 200, pages_of("z1")), ("twice", 200, pages_of("a1")), ("twice", 500, pages_of("0")), ("d", 200, pages_of("d1")),
    (None, 200, pages_of("nowhere")), ("many", 200, pages_of(*[f"m{i}" for i in range(30)])),
]


def walk(maps, url, depth, deepest):
    lists = {}
    for u, status, body in maps:
        if u is not None and status == 200 and body:
            lists[u] = min(body, lists.get(u, body))
    body = lists.get(url, "")
    if depth > deepest or "</" not in body:
        return []
    locs = [x.split("</loc>")[0] for x in body.split("<loc>")[1:]]
    return [p for x in locs for p in walk(maps, x, depth + 1, deepest)] if "sitemapindex" in body else locs


def test_recursion_lists_pages_in_document_order(session):
    docs = session.createDataFrame(MAPS, "url string, status int, body string")
    starts = [("s1", "a", 1), ("s1", "c", 2), ("s2", "deep", 1), ("s3", "twice", 1), ("s3", "broken", 2), ("s4", "many", 1),
              ("s4", "none", 2), ("s5", "a", 1)]
    start = session.createDataFrame(starts, "domain string, sitemap string, rank int")
    out = sitemap_pages(start, docs, max_depth=3, max_urls=12)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "UnionLoop" in plan and "body" not in plan
    got = {}
    for r in out.orderBy("domain", "root", "n").collect():
        got.setdefault((r.domain, r.root), []).append(r.page)
    want = {(d, u): walk(MAPS, u, 0, 3)[:12] for d, u, _ in starts}
    assert got == {k: v for k, v in want.items() if v}
    assert sitemap_pages(start.where("false"), docs).count() == 0 and sitemap_edges(docs.where("false")).count() == 0


# ---- page corpus -------------------------------------------------------------------------------
def test_a_round_reads_its_buckets_and_moves_no_html(session, monkeypatch):
    from leadloom.plans import corpus as K
    from leadloom.session import cut
    rows = [(f"HTTP://Site{i}.net/a?utm_source=x", f"<p>{i}</p>") for i in range(300)]
    rows += [("http://site7.net/a", "<p>7 again</p>"), ("mailto:x@y.z", "no page"), (None, "no url"), ("http://site301.net/", None)]
    stored = K.StoredCorpus.store(session.createDataFrame(rows, "url string, html string"), buckets=8)
    asked = [f"http://site{i}.net/a" for i in (7, 8, 999)] + ["http://site301.net/"]
    frontier = cut(session.createDataFrame([(u, n) for n, u in enumerate(asked)] + [(None, 9)], "url string, n int"))
    for most in (1000, 2):
        monkeypatch.setattr(K, "LOOKUP", most)
        out = stored.fetch(frontier)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert ("out of 8" in plan and "SelectedBucketsCount: 8 " not in plan) == (most == 1000)
        assert {r.n: r.html for r in out.collect()} == {0: "<p>7</p>", 1: "<p>8</p>", 2: None, 3: None, 9: None}
    monkeypatch.setattr(K, "LOOKUP", 1000)
    assert K.pages_at(K.corpus_by_url(session.createDataFrame(rows, "url string, html string")), frontier).count() == 5


def test_crawl_order_does_not_collide_beyond_a_thousand_links(session):
    """The second page's first link comes after all links of the first page."""
    from leadloom.plans.crawl import CrawlOptions, expand
    many = "".join(f'<a href="/contact-{i}">c</a>' for i in range(1100))
    rows = [("http://a.net/", many), ("http://a.net/two", '<a href="/kontakt">k</a>')]
    corpus = session.createDataFrame(rows, "url string, html string")
    seeds = session.createDataFrame([("a.net", u, n) for n, (u, _) in enumerate(rows)], "domain string, url string, seq int")
    r = expand(seeds, corpus, CrawlOptions(max_pages=1200, blocklist=()))
    ranks = {v.url: v.page_rank for v in r.visited.where("depth = 1").collect()}
    assert len(ranks) == 1101 and max(ranks.values()) == ranks["http://a.net/kontakt"] == 1101


def test_sites_that_show_the_same_address_all_have_it(session):
    from leadloom.plans.corpus import StoredCorpus
    from leadloom.plans.crawl import CrawlOptions, expand

    pages = [(f"https://{d}.net/", '<p>write to desk@mail.org</p><a href="/shop">s</a>') for d in ("a", "b", "c")]
    corpus = StoredCorpus.store(session.createDataFrame(pages, "url string, html string"), buckets=2)
    seeds = session.createDataFrame([(f"{d}.net", f"https://{d}.net/", 0) for d in ("a", "b", "c")], "domain string, url string, seq int")
    r = expand(seeds, corpus, CrawlOptions(blocklist=()))
    assert {(x.domain, x.value) for x in r.contacts.collect()} == {(f"{d}.net", "desk@mail.org") for d in ("a", "b", "c")}
    # a site with an address does not fall back to plain links
    assert r.visited.where("depth = 1").count() == 0


def test_crawl_takes_the_links_of_a_round_from_its_pages_once(session, monkeypatch):
    """Directories, contact links and plain links share one pass over the HTML; each finds what it found."""
    from leadloom.operators import pages
    from leadloom.plans.crawl import CrawlOptions, expand

    passes, hrefs = [], pages.raw_hrefs
    monkeypatch.setattr(pages, "raw_hrefs", lambda *a, **kw: passes.append(1) or hrefs(*a, **kw))
    outward = "".join(f'<a href="https://www.org{i}.com/about">o</a>' for i in range(6))
    corpus = session.createDataFrame([
        ("https://site1.com/", '<a href="/shop">s</a><a href="/contact">c</a>' + outward),
        ("https://site2.com/", '<a href="/shop">s</a><a href="/cart">k</a>')], "url string, html string")
    seeds = session.createDataFrame([(f"site{i}.com", f"https://site{i}.com/", 0) for i in (1, 2)],
                                    "domain string, url string, seq int")
    r = expand(seeds, corpus, CrawlOptions(blocklist=()))
    assert len(passes) == 1
    assert {(x.domain, x.url, x.depth, x.fetched) for x in r.visited.collect()} == {
        ("site1.com", "https://site1.com/", 0, True), ("site2.com", "https://site2.com/", 0, True),
        ("site1.com", "https://site1.com/contact", 1, False),
        ("site2.com", "https://site2.com/shop", 1, False), ("site2.com", "https://site2.com/cart", 1, False)}
    assert [(x.domain, x.listed_orgs) for x in r.directories.collect()] == [("site1.com", 6)]
    assert {x.domain for x in r.found.collect()} == {f"org{i}.com" for i in range(6)}
