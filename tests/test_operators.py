"""Operators on small inline tables with the values they must give."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions.emails import is_valid_email
from leadloom.functions.urls import registrable_domain, with_block_reason, with_normalised_url
from leadloom.operators import leads as L
from leadloom.operators.pages import cookies
from leadloom.operators.rendering import markdown_of, plain_text, to_markdown
from leadloom.sources.tables import robots_rules, with_robots_gate


def column(session, values, name="c"):
    return session.createDataFrame([(v,) for v in values], f"{name} string")


def test_email_validity(session):
    bad = ["a@b", "@nowhere.com", "no-at-sign.com", "x@1.2.3", "logo@2x.png", "sprite@3x.webp", "test@test.com",
           "a@b.js", "double@@at.com", ""]
    good = ["john.doe@company.co.uk", "info@acme.com", "a_b+tag@sub.domain.io", "hello@xn--80ak6aa92e.com",
            "sales@company-name.com.pk"]
    rows = column(session, bad + good).select("c", is_valid_email(F.col("c")).alias("ok")).collect()
    assert {r.c for r in rows if r.ok} == set(good)


def test_url_normal_form_and_domain(session):
    want = {"https://Acme.com/path/?utm_source=x&id=2#frag": "https://acme.com/path?id=2",
            "http://acme.com:80/a//b/": "http://acme.com/a/b", "javascript:void(0)": None, "mailto:a@b.com": None}
    rows = with_normalised_url(column(session, want), "c", "n").collect()
    assert {r.c: r.n for r in rows} == want
    hosts = {"www.acme.co.uk": "acme.co.uk", "a.b.acme.com": "acme.com", "shop.acme.com.pk": "acme.com.pk",
             "acme.com": "acme.com"}
    rows = column(session, hosts).select("c", registrable_domain(F.col("c")).alias("d")).collect()
    assert {r.c: r.d for r in rows} == hosts


def test_url_safety(session):
    unsafe = ["http://169.254.169.254/latest/meta-data/", "http://metadata.google.internal/computeMetadata/v1/",
              "http://100.100.100.100/", "http://localhost:8080/admin", "http://127.0.0.1:6379/", "http://[::1]:8000/",
              "http://10.0.0.5/internal", "http://192.168.1.1/router", "http://172.16.0.1/", "http://100.64.0.1/",
              "http://0.0.0.0:80/", "http://foo.localhost/", "http://svc.internal/", "file:///etc/passwd",
              "ftp://x.com/", "gopher://x.com/", "javascript:alert(1)", "http://example.com:22/",
              "http://example.com:3306/"]
    safe = ["https://example.com/", "http://93.184.216.34/", "https://sub.acme.co.uk/x"]
    rows = with_block_reason(column(session, unsafe + safe), "c").collect()
    assert {r.c for r in rows if r.block_reason is None} == set(safe)


@pytest.mark.parametrize("body, agent, allowed", [
    ("User-agent: leadloom\nCrawl-delay: 5\nUser-agent: other\nDisallow: /\n", "leadloom", True),
    ("User-agent: leadloom\nCrawl-delay: 5\nUser-agent: other\nDisallow: /\n", "other", False),
    ("User-agent: leadloom\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /\n", "leadloom", True),
    ("User-agent: leadloom\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /\n", "other", False),
    ("User-agent: leadloom\n\nUser-agent: *\nDisallow: /\n", "leadloom", False),
    ("User-agent: leadloom\nUser-agent: other\nDisallow: /\n", "leadloom", False),
    ("Crawl-delay: 5\nDisallow: /\n", "leadloom", True),
    ("", "leadloom", True),
    (None, "leadloom", True),
])
def test_robots(session, body, agent, allowed):
    files = session.createDataFrame([("https://a.com", True, body), ("https://b.com", False, "User-agent: *\nDisallow: /")],
                                    "origin string, ok boolean, body string")
    urls = column(session, ["https://a.com/x", "https://b.com/x", "https://unknown.com/x"], "u")
    got = {r.u: r.allowed for r in with_robots_gate(urls, robots_rules(files), "u", agent).collect()}
    assert got == {"https://a.com/x": allowed, "https://b.com/x": True, "https://unknown.com/x": True}


def test_robots_size_limit_is_the_callers(session):
    files = session.createDataFrame([("https://a.com", True, "User-agent: *\nDisallow: /\n" + "#" * 600_000)],
                                    "origin string, ok boolean, body string")
    assert robots_rules(files).count() == 1
    assert robots_rules(files, max_chars=512_000).count() == 0


def test_email_cap_keeps_role_mailboxes(session):
    rows = [("acme.com", "email", f"person{i:03}@acme.com", 0.9, "u") for i in range(300)]
    rows += [("acme.com", "email", "info@acme.com", 0.9, "u"), ("acme.com", "phone", "+15550100", 0.5, "u")]
    table = session.createDataFrame(rows, "domain string, kind string, value string, confidence double, source_url string")
    kept = [r.value for r in L.cap_emails(table, 25).where("kind = 'email'").collect()]
    assert len(kept) == 25 and "info@acme.com" in kept
    assert L.truncated_emails(table, 25).first().emails_truncated == 301
    assert L.cap_emails(table, 25).where("kind = 'phone'").count() == 1
    assert L.cap_emails(table, 0).count() == 302


def test_cookies(session):
    headers = {1: "a=1; b=2; Path=/", 2: 'sid="v12"; Secure; HttpOnly; Domain=x.com', 3: "Path=/; a=1", 4: "a=1; word",
               5: "a=1; a=2", 6: "", 7: None}
    table = session.createDataFrame([(k, {"set-cookie": v} if v is not None else {"server": "x"}) for k, v in headers.items()],
                                    "k int, headers map<string,string>")
    got = {(r.k, r.name): (r.value, r.path, r.secure, r.domain) for r in cookies(table, ["k"]).collect()}
    assert got == {(1, "a"): ("1", None, False, None), (1, "b"): ("2", "/", False, None),
                   (2, "sid"): ("v12", None, True, "x.com"), (5, "a"): ("2", None, False, None)}


def test_lead_rows_are_bounded_and_count_what_they_leave_out(session):
    contacts = session.range(25_000).selectExpr(
        "'hub.com' AS domain", "CASE WHEN id % 2 = 0 THEN 'email' ELSE 'phone' END AS kind",
        "concat('v', lpad(id, 6, '0')) AS value", "0.5D AS confidence", "'u' AS source_url")
    row, = L.lead_documents(contacts, top=10).collect()
    assert row.emails == [f"v{i:06}" for i in range(0, 20, 2)] and row.n_listed == 20 and row.n_known == 25_000
    assert row.counts == {"email": 12_500, "phone": 12_500}
    shown, = L.display_rows(L.lead_documents(contacts).selectExpr("*", "'n' AS name", "1.0D AS score")).collect()
    assert shown.emails == "v000000 v000002 v000004 v000006 +12496 more"
    places = L.ranked_contacts(contacts).where("place in (1, 12500, 12501, 25000)").orderBy("place").collect()
    assert [(r.kind, r.value) for r in places] == [
        ("email", "v000000"), ("email", "v024998"), ("phone", "v000001"), ("phone", "v024999")]


def test_indexed_search_finds_what_a_scan_finds(session, tmp_path):
    import random

    from leadloom.operators.search import LeadIndex, search
    rng = random.Random(2)
    words = ["".join(rng.choice("ab.@é") for _ in range(rng.randint(0, 7))) for _ in range(120)]
    leads = session.createDataFrame([(f"d{i}.com", w if i % 3 else None) for i, w in enumerate(words)], "domain string, name string")
    contacts = session.createDataFrame([(f"d{rng.randrange(130)}.com", rng.choice(["email", "phone", "github"]), w.upper())
                                        for w in words * 3], "domain string, kind string, value string")
    index = LeadIndex.build(leads, contacts, str(tmp_path / "index"), buckets=4)
    held = {}
    for r in contacts.where("kind <> 'github'").collect():
        held.setdefault(r.domain, []).append(r.value.lower())
    for q in ("", "a", "B@", "aB.", "é@é", "a.b@", "d1", "d11.com", "zzz", "aaaa"):
        want = {r.domain for r in leads.collect() if any(q.lower() in t for t in [r.domain, r.name or "", *held.get(r.domain, [])])}
        assert {r.domain for r in search(leads, contacts, q).collect()} == want, q
        assert {r.domain for r in search(leads, contacts, q, index=index).collect()} == want, q
    mailed = {r.domain for r in contacts.where("kind = 'email'").collect()}
    assert {r.domain for r in search(leads, contacts, "", True).collect()} == mailed & {r.domain for r in leads.collect()}


def test_one_failing_format_does_not_stop_the_others(session, tmp_path):
    from leadloom import sinks as S
    leads = session.createDataFrame([("a.com", "A", 50.0, "http://a.com/", 1)], "domain string, name string, score double, url string, pages_crawled int")
    contacts = session.createDataFrame([("a.com", "email", "x@a.com", 0.9, "u", {"k": "v"})],
                                       "domain string, kind string, value string, confidence double, source_url string, meta map<string,string>")
    rows = leads.join(L.lead_documents(contacts), "domain")
    flat = L.export_rows(leads, L.lead_documents(contacts))
    path = str(tmp_path / "out")
    bad = flat.withColumn("name", F.raise_error(F.lit("no csv today")).cast("string"))
    got = dict(S.write_all(rows, bad, leads, contacts, path, ["all", "docx"]))
    assert got.pop("csv").startswith("failed") and got.pop("docx") == "unknown"
    assert got == dict.fromkeys(("json", "jsonl", "md", "tables"), "written")
    assert session.read.json(f"{path}/jsonl").head().emails == ["x@a.com"]


def test_merge_keeps_first_spelling_and_best_confidence(session):
    rows = [("acme.com", "email", "a@acme.com", 0.4, "u1", 1), ("acme.com", "email", "A@ACME.COM", 0.9, "u2", 2)]
    table = session.createDataFrame(rows, "domain string, kind string, value string, confidence double, source_url string, seq int")
    row, = L.best_contacts(table, ["seq"]).collect()
    assert (row.value, row.confidence, row.source_url) == ("a@acme.com", 0.9, "u2")


@pytest.mark.parametrize("html, want", [
    (None, "\n"), ("", "\n"),
    ("<h1>A &amp; B</h1><p>x <b>y</b>, z", "# A & B\nx **y**, z\n"),
    ("<ul><li>one<li>two<ol><li>a</li><li>b</li></ol></li></ul>after", "- one\n- two\n  1. a\n  2. b\nafter\n"),
    ("<pre><code>x = 1\n\n y</code></pre>", "```\nx = 1\n\n y\n```\n"),
    ("<a href='/p'>l</a><script>s</script><iframe>f</iframe><hr>e", "[l](https://h.com/p)\n---\ne\n"),
    ("</b></p>x</div>", "x\n"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep\n"),
    ("<a href='http://[bad'>l</a>", "[l](http://[bad)\n"),
])
def test_markdown(html, want):
    assert to_markdown(html, "https://h.com/d/") == want


def test_plain_text(session):
    pages = session.createDataFrame([(1, "<h2>T</h2><p>See <a href='/x'>this</a> <img src='i' alt='pic'></p><ol><li>one</ol>"),
                                     (2, None)], "k int, html string")
    got = {r.k: r.t for r in markdown_of(pages, ["k"]).select("k", plain_text(F.col("markdown")).alias("t")).collect()}
    assert got == {1: "T\nSee this pic\n- one\n", 2: "\n"}


def test_lead_rows_list_every_contact(session):
    contacts = session.range(9_000).selectExpr(
        "'hub.com' AS domain", "element_at(array('email', 'phone', 'github'), CAST(id % 3 AS INT) + 1) AS kind",
        "concat('v', lpad(id, 6, '0')) AS value", "0.5D AS confidence", "'u' AS source_url")
    row, = L.lead_documents(contacts).collect()
    assert len(row.contacts) == row.n_listed == row.n_known == 9_000
    assert len(row.emails) == len(row.phones) == len(row.socials["github"]) == 3_000 and row.phones[25] == "v000076"
    leads = session.createDataFrame([("hub.com", "H", 50.0, 1)], "domain string, name string, score double, pages_crawled int")
    flat, = L.export_rows(leads, L.lead_documents(contacts)).collect()
    assert flat.phones.split("; ") == row.phones


def test_batches_for_python_end_by_size(session):
    """Long texts reach a Python task in batches of a few MB, and few pages at a time become Markdown."""
    import pyarrow as pa

    from leadloom.operators.rendering import PAGES, markdown_of
    from leadloom.session import configure

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    configure(session)
    pages = session.range(0, 2000, 1, 1).select(F.col("id").alias("page_id"), F.repeat(F.lit("<p>long</p>"), 2000).alias("html"))
    got = pages.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 2000 and max(r.size for r in got) < 9_000_000
    narrow = session.range(0, 3 * PAGES + 1, 1, 1).select(F.col("id").alias("page_id"), F.format_string("<p>page %d</p>", "id").alias("html"))
    assert {r.page_id: r.markdown for r in markdown_of(narrow, ["page_id"]).collect()} == {
        i: f"page {i}\n" for i in range(3 * PAGES + 1)}
