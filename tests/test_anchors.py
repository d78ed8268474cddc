"""The anchor scan against the patterns run over whole texts, on random and on hostile pages."""

import html as entities
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from leadloom import rules
from leadloom.operators import anchors as A
from leadloom.operators import contacts as C

PIECES = [
    "@", "a@b.com", "x.y+z", ".", "-", "_", "a", "B9", "b.co", "com", " ", "  ", "\n", "é", "İ", "ſ", "K", "%20", "&amp;", "&#64;",
    "mailto:", "MailTo:", "href=", "HREF = ", "content='", '"', "'", ">", "<", "?", ",", "tel:", "+1 (555) 010-77", "00", "4742147",
    'data-cfemail="', "data-cfemail=\"2b484d1c6b58434e4f4e5f05424442\"", "DATA-cfemail=\"12ab\"", "12ab34", "'a'+'@'+'b.io'",
    "'x' + '' + \"y.net\"", "+", "''", "'@'", "(at)", "[ at ]", " at ", " AT ", " dot ", "(dot)", "{punkt}", "acme", "org",
    "https://", "http://", "www.", "linkedin.com/", "de.LinkedIn.com/in/", "company/acme", "x.com/", "twitter.com/share", "i/",
    "github.com/", "a/b", "t.me/", "join_us", "wa.me/", "+49151234567", "api.whatsapp.com/send?phone=", "youtube.com/@", "channel/",
    "medium.com/", "facebook.com/tr", "instagram.com/p/", "tiktok.com/@u", "site.org/", "id=123456789",
    "<script>", "<SCRIPT type='application/json'>", "<script type=\"application/ld+json\">", "</script>", "</Script>", "<style>",
    "</style>", "<svg", "</svg>", "<br>", "self.__next_f.push(", "window.__NUXT__ =", "\\u0040", "\\x2e", "\\/", "{\"a\":1}", "tel ",
    "هاتف ", "call: ", "fax –", "2024-01-02", "10.0.0.1", " ext 12", " ", "\x1c",
]


def pages(seed, n, most=24):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, most))) for _ in range(n)]


def java(pattern):
    return A._compiled(pattern)


def all_of(pattern, text, group=0):
    return [m[group] for m in java(pattern).finditer(text)]


def places(text):
    found = {}
    for end, (n, families) in A.automaton().iter(A.lowered(text)):
        for f in families:
            found.setdefault(f, []).append(end - n + 1)
    return found


def spelled(text):
    out = []
    for pattern in (rules.OBFUSCATED_MARK, rules.OBFUSCATED_WORD):
        for m in java(pattern).finditer(text):
            local, domain = m[1].strip(" .,;:"), java(rules.DOT_WORD).sub(".", m[2]).replace(" ", "").strip(".")
            if local and "." in domain:
                out.append(f"{local}@{domain}")
    return out


def whole_text_state(text):
    blobs = [m[1] for p in (rules.STATE_BLOB, rules.JSON_SCRIPT) for m in java(p).finditer(text) if m[1]]
    s = java(rules.ESCAPED_DOT).sub(".", java(rules.ESCAPED_AT).sub("@", " ".join(blobs)))
    return entities.unescape(s.replace("\\/", "/").replace('\\"', '"').replace("\\n", " ")) if blobs else ""


def whole_text_urls(text):
    return re.sub(r"\bhttps?://\S+|\bwww\.\S+|\b\w\S*\.(?:com|org|net|io)/\S*", " ", text, flags=re.I)


def whole_text_phones(text):
    cue = re.compile(f"(?:{'|'.join(rules.PHONE_CUES)}){rules.PHONE_CUE_SEPARATOR}*$", re.I)
    return [m[0] for m in java("(?iU)" + rules.PHONE).finditer(text)
            if m[0].startswith(("+", "00")) or len(re.findall(r"\d+", m[0])) > 1 or "(" in m[0]
            or cue.search(text[max(0, m.start() - 40):m.start()])]


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_patterns_over_whole_texts(seed):
    for text in pages(seed, 1500):
        low, at = A.lowered(text), places(text).get
        assert len(low) == len(text)
        assert A.plain_emails(text) == all_of(rules.EMAIL, text), text
        assert A.plain_emails(text, at("@", ())) == all_of(rules.EMAIL, text), text
        assert A.spelled_out_emails(text, low) == spelled(text), text
        assert A.concatenated_emails(text, at("+", ())) == [
            f"{m[1]}@{m[2]}" for m in java(rules.JS_CONCAT).finditer(text)], text
        assert A.mailto_emails(text, low, at("mailto", ())) == [
            m.split(",", 1)[0] for m in all_of(rules.MAILTO, text, 1)], text
        assert A.tel_links(text, low, at("tel", ())) == all_of(rules.TEL, text, 1), text
        assert len(A.cloudflare_emails(text, at("cf", ()))) == sum(len(t) > 3 for t in all_of(rules.CFEMAIL, text, 1)), text
        for kind in rules.SOCIAL_PATTERNS:
            assert A.profiles(kind, text, low, at(kind, ())) == all_of(rules.SOCIAL_PATTERNS[kind], text, 1), (kind, text)
        assert A.visible_text(text, low) == entities.unescape(
            java(rules.TAG).sub(" ", java(rules.SCRIPT_STYLE).sub(" ", text))), text
        if "state" in places(text) or whole_text_state(text):
            assert A.embedded_state(text, low) == whole_text_state(text), text
        assert A.without_urls(text, low) == whole_text_urls(text), text
        assert A.dialable_runs(text) == whole_text_phones(text), text


def test_scan_equals_column_expressions(session):
    """The families as expressions of the JVM, on the same pages."""
    texts = [t for t in pages(77, 600, 40) if not re.search("[İſK\x1c é]", t)]
    df = session.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    h = F.col("html")
    got = df.select("page_id", C.plain_emails(h).alias("mail"), C.mailto_emails(h).alias("to"), C.tel_links(h).alias("tel"),
                    C.concatenated_emails(h).alias("js"), C.cloudflare_emails(h).alias("cf"), C.obfuscated_emails(h).alias("at"),
                    F.struct(*[v.alias(k) for k, v in C.social_profiles(h).items()]).alias("social")).collect()
    for r in got:
        text = texts[r.page_id]
        low, at = A.lowered(text), places(text).get
        assert r.mail == A.plain_emails(text), text
        assert r.to == A.mailto_emails(text, low, at("mailto", ())), text
        assert r.tel == A.tel_links(text, low, at("tel", ())), text
        assert r.js == A.concatenated_emails(text, at("+", ())), text
        assert r.cf == A.cloudflare_emails(text, at("cf", ())), text
        assert r["at"] == A.spelled_out_emails(text, low), text
        assert {k: v for k, v in r.social.asDict().items() if v} == {
            k: p for k in rules.SOCIAL_PATTERNS if (p := A.profiles(k, text, low, at(k, ())))}, text


def test_structured_contacts_equal_page_facts(session):
    from leadloom.operators.structured import with_jsonld
    blocks = [
        {"@type": "Organization", "telephone": " +1  555 0100 ", "email": "mailto:a@b.org"}, [{"@type": "Event", "telephone": "no"}],
        {"@graph": [{"@type": ["Thing", "Store"], "email": ""}, {"type": "Person", "email": "p@q.io", "telephone": 4155550100}]},
        {"@type": "WebPage", "mainEntity": {"@type": "Hotel", "telephone": "1"}, "publisher": {"@type": "School", "email": "s@t.edu"}},
        {"@type": None, "type": "dentist", "telephone": None, "author": [{"@type": "person", "telephone": "x" * 60}]}, "text", None, 7,
    ]
    raw = [json.dumps(b) for b in blocks] + ['{"@type":"Store","email":"c@d.org",}', "{broken", "[" * 3000, ""]
    rng = random.Random(3)
    texts = ["".join(f"<script class=x type='application/ld+json'>{rng.choice(raw)}</script> " for _ in range(rng.randint(0, 4)))
             for _ in range(150)]
    df = session.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    for r in with_jsonld(df).select("page_id", "jsonld.telephone", "jsonld.email").collect():
        found = A.structured_contacts(texts[r.page_id], A.lowered(texts[r.page_id]))
        assert (r.telephone, r.email or None) == (found.get("telephone"), found.get("email")), texts[r.page_id]


HOSTILE = {
    "open scripts": "<script>" * 40_000, "open tags": "<" * 400_000, "mails": "a@" * 150_000, "labels": "a@" + "b." * 200_000,
    "marks": "a (at) " * 60_000 + "b", "blanks": "mailto:" + " " * 400_000 + "mailto:", "quotes": "''+" * 100_000,
    "hosts": "linkedin.com/" * 40_000, "one word": "x" * 400_000 + "linkedin.com/", "slashes": "://" * 130_000,
    "digits": "1" * 300_000, "groups": "12 34 " * 60_000, "cf": 'data-cfemail="' * 30_000, "local": "a" * 400_000 + "@b.com",
    "json": '<script type="application/json">' * 10_000, "ld": '<script type="application/ld+json">{' * 10_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_end_soon(name):
    began = time.time()
    A.page_finds(HOSTILE[name], frozenset(C.FAMILIES), True, True)
    assert time.time() - began < 5


def test_pages_without_text_and_clashing_columns(session):
    rows = [(1, None, "http://a.com/", "x"), (2, "", None, "y"), (3, "<p>me@firm.io</p>", None, "z"), (3, "<p>me@firm.io</p>", "u", "z")]
    df = session.createDataFrame(rows, "page_id long, html string, url string, kind string")
    got = C.contacts_of(df.drop("kind"), ["page_id"], dedup=False, blocklist=()).select("page_id", "value").distinct().collect()
    assert [tuple(r) for r in got] == [(3, "me@firm.io")]
    assert C.contacts_of(df.where("false"), ["page_id"]).count() == 0


CROWDED = ("see a.b@c1.com d@e2.org and f@g3.net.", "d 4387393285946913 +1 (438) 555-5817 +1 (274) 555-4153 x",
           "190.137.223.204 x +1 (826) 555-4081 190.137.223.204 du", "é.20@mail5.example.com\nq@r.io", "t@u.io +44 20 7946 1234 t@u.io", "")


@pytest.mark.parametrize("name", ["con3_plain_visible", "con4_plain_raw", "con10_page_emails", "con12_phone_candidates", "con16_page_phones",
                                  "con19_all_contacts", "lead_scores_by_host", "lead_scores_by_source"])
def test_finds_side_by_side_are_those_of_the_sql(session, tmp_path, name):
    import __spark_entry__ as entry
    import compare

    documents = [(i, text, f"s{i % 2}", "en", len(text)) for i, text in enumerate(CROWDED)]
    pages = [(i, f"https://h{i % 2}.net/p", f"<html><head><title>T</title></head><body><p>{text}</p></body></html>") for i, text in enumerate(CROWDED)]
    for table, rows, schema in (("documents", documents, "doc_id bigint, text string, source string, lang string, n_chars int"),
                                ("pages", pages, "page_id bigint, url string, html string")):
        session.createDataFrame(rows, schema).toPandas().to_parquet(str(tmp_path / f"{table}.parquet"))
    assert compare.compare(session, compare.duck(str(tmp_path)), str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_by_default_finds_may_share_a_border():
    assert A.plain_emails(CROWDED[0]) == ["a.b@c1.com", "d@e2.org", "f@g3.net"]
    assert A.own_emails(CROWDED[0]) == ["a.b@c1.com", "f@g3.net"]
    assert A.dialable_runs(CROWDED[1]) == ["+1 (438) 555-5817", "+1 (274) 555-4153"]
    assert A.dialable_runs(CROWDED[1], own_borders=True) == ["1 (438) 555-5817", "1 (274) 555-4153"]


WRITTEN = {
    "con3_plain_visible": ["&lt;joe&#64;firm.com joe&amp;a@b.com", None],
    "con12_phone_candidates": ["see shop.com/2024-12345 x", "éhttp://x.io/555-12345 y", "555\x0b12345", None],
    "con16_page_phones": ["tel 4387393285", "https://a.io/020-7946-1000", "12000 x 800", "0 001000 12345", "7946<0555", "&#160;555 12345;", None],
    "con19_all_contacts": ["tel 4387393285", "https://a.io/020-7946-1000", "12000 x 800", "<script type=1>020 7946 1000</script>",
                           "<svg>555 12346</svg>", "020&#160;7946 55"],
}


@pytest.mark.parametrize("name", WRITTEN)
def test_finds_in_written_text_are_those_of_the_sql(session, tmp_path, name):
    import __spark_entry__ as entry
    import compare

    documents = [(i, text, f"s{i % 2}", "en", 1) for i, text in enumerate(WRITTEN[name])]
    pages = [(i, f"https://h{i % 2}.net/p", f"<html><head><title>T</title></head><body><p>{text}</p></body></html>") for i, text in enumerate(WRITTEN[name])]
    for table, rows, schema in (("documents", documents, "doc_id bigint, text string, source string, lang string, n_chars int"),
                                ("pages", pages, "page_id bigint, url string, html string")):
        session.createDataFrame(rows, schema).toPandas().to_parquet(str(tmp_path / f"{table}.parquet"))
    assert compare.compare(session, compare.duck(str(tmp_path)), str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_spelled_out_search_from_marks(session):
    """Sought from their marks, spelled-out addresses are those of the rules' patterns, long runs and neighbours included."""
    rng = random.Random(5)
    bits = ["a", "b.c", "_x", "@", " at ", "(at)", "[ AT ]", " dot ", "(dot)", ".", ".com", "-", "com", "x" * 70, "y" * 64, " ", "\n",
            "ſ", "K", "ı", "é", "日本", "punkt", "%", " arroba ", "9z", "("]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["a@b.com@c.de", "a@b.com-x@y.de", "x" * 64 + " (at) b.de", "x" * 65 + " at b dot de", None, "", "@b.de"]
    df = session.createDataFrame([(t,) for t in texts], "t string")
    t, found = F.col("t"), 0
    for rule, ours in ((rules.OBFUSCATED_MARK, C.SPELLED_MARK), (rules.OBFUSCATED_WORD, C.SPELLED_WORD)):
        for r in df.select("t", *[C._all(t, p, g).alias(f"{n}{g}") for n, p in (("a", rule), ("b", ours)) for g in (1, 2)]).collect():
            assert (r.a1, r.a2) == (r.b1, r.b2), r.t
            found += len(r.a1 or ())
    assert found > 100
