"""Contact extraction: page table in, long contacts table out.

One search for anchors (``anchors``) gathers the raw finds of all families of
a page; after one explode, cleaning, validity and confidence are plain column
expressions over small rows.  The families also exist as column expressions of
their own, for text columns and single families.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.emails import (
    decode_cfemail, email_confidence, is_role, is_valid_email, tidy_email)
from ..functions.phones import with_normalised_phone
from ..functions.text import pin, strip
from ..functions.urls import host_of, registrable_domain
from .anchors import with_finds

FAMILIES = ("email", "phone", "social")
#: URLs and the digit runs inside them, removed before phones are looked for.
#: The look-behind pins the third form to the first word of a blank-free run,
#: where it would match anyway, which keeps the search linear.
URL_IN_TEXT = (r"(?iU)\bhttps?://\S+|\bwww\.\S+|"
               r"\b(?=\w)(?<=(?:^|\s)[^\w\s]{0,32})\S+\.(?:com|org|net|io)/\S*")
#: What any match of the pattern above contains.
URL_SIGN = r"(?iU)://|www\.|\.(?:com|org|net|io)/"
#: A letter, digit or sign of a name, in any case (four letters outside ASCII fold to one inside), listed one by one:
#: the JVM looks those up in a table, while it folds each text character anew for a range.
_NAME = "(?-i:[" + "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))) + "._%+\\-ſıİK])"


def _from_mark(pattern: str) -> str:
    """A spelled-out pattern that is sought from its mark; groups 1 and 2 as before.

    No mark begins with a name character, so the name is what stands before
    the mark: its whole run, or the last 64 characters, or what the find before left.
    """
    rest = pattern.removeprefix("(?iU)([A-Za-z0-9._%+-]{1,64}?)")
    at = rest.index("((?:[A-Za-z0-9-]")
    mark, domain = rest[:at], rest[at:]
    before = rf"(?:\G|(?<!{_NAME})|(?={_NAME}{{64}}(?!{_NAME})))({_NAME}{{1,64}}+)"
    return rf"(?iU)(?=[\s@(\[{{])(?<={_NAME})(?!\G)(?={mark})(?<={before}){mark}{domain}"


SPELLED_MARK, SPELLED_WORD = _from_mark(rules.OBFUSCATED_MARK), _from_mark(rules.OBFUSCATED_WORD)
NONE = "array<string>"
SOCIAL_HOSTS = {kind: (f"{kind}.com/",) for kind in rules.SOCIAL_PATTERNS} | {
    "twitter": ("twitter.com/", "x.com/"), "telegram": ("t.me/", "telegram.me/"),
    "whatsapp": ("api.whatsapp.com/", "wa.me/")}

def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def cloudflare_emails(html: Column) -> Column:
    return F.filter(F.transform(_all(html, rules.CFEMAIL, 1), decode_cfemail),
                    lambda e: e.isNotNull())


def mailto_emails(html: Column) -> Column:
    return F.transform(_all(html, rules.MAILTO, 1), lambda m: F.substring_index(m, ",", 1))


def _where(sign: Column, found: Column) -> Column:
    """Run a search only on texts that hold what every match must contain."""
    return F.when(sign, found).otherwise(F.array().cast(NONE))


#: An address together with the characters around it.
OWN_EMAIL = r"(?:\A|[^\p{L}\p{N}_.+-])(" + rules.EMAIL_BODY + r")(?:\z|[^\p{L}\p{N}_-])"


def plain_emails(text: Column, own_borders: bool = False) -> Column:
    """Addresses in a text; with ``own_borders`` two of them do not share the character between them."""
    return _where(text.contains("@"), _all(text, OWN_EMAIL, 1) if own_borders else _all(text, rules.EMAIL))


def obfuscated_emails(visible: Column) -> Column:
    """Addresses written as ``name (at) domain (dot) tld``."""
    # what any find contains, by plain searches
    mark = reduce(or_, [visible.contains(c) for c in "@([{"])
    word = reduce(or_, [F.lower(visible).contains(w) for w in ("dot", "punkt", "nokta", "punto")])
    found = []
    for pattern, sign in ((SPELLED_MARK, mark), (SPELLED_WORD, word)):
        pairs = F.arrays_zip(_all(visible, pattern, 1).alias("l"), _all(visible, pattern, 2).alias("d"))
        found.append(_where(sign, F.filter(
            F.transform(pairs, lambda p: _spelled_out(p["l"], p["d"])), lambda e: e.isNotNull())))
    return F.concat(*found)


def _spelled_out(local: Column, domain: Column) -> Column:
    local = F.regexp_replace(local, r"^[ .,;:]+|[ .,;:]+$", "")
    dotted = F.regexp_replace(domain, rules.DOT_WORD, ".")
    dotted = F.regexp_replace(F.replace(dotted, F.lit(" "), F.lit("")), r"^\.+|\.+$", "")
    return F.when((local != "") & dotted.contains("."), F.concat(local, F.lit("@"), dotted))


def concatenated_emails(html: Column) -> Column:
    """Addresses joined in script code: ``'name' + '@' + 'domain.tld'``."""
    pairs = F.arrays_zip(_all(html, rules.JS_CONCAT, 1).alias("l"),
                         _all(html, rules.JS_CONCAT, 2).alias("d"))
    return _where(html.contains("+"), F.transform(pairs, lambda p: F.concat(p["l"], F.lit("@"), p["d"])))


def tel_links(html: Column) -> Column:
    return _all(html, rules.TEL, 1)


def without_urls(visible: Column) -> Column:
    return F.when(visible.rlike(URL_SIGN), F.regexp_replace(visible, URL_IN_TEXT, " ")).otherwise(visible)


def social_profiles(html: Column) -> dict[str, Column]:
    low = F.lower(html)
    return {kind: _where(F.greatest(*[low.contains(host) for host in SOCIAL_HOSTS[kind]], F.lit(False)),
                         _all(html, pattern, 1)) for kind, pattern in rules.SOCIAL_PATTERNS.items()}


def social_url(kind: Column, handle: Column) -> Column:
    base = None
    for name, prefix in rules.SOCIAL_BASES.items():
        base = (F if base is None else base).when(kind == name, prefix)
    bare = strip(F.regexp_replace(handle, "/+$", ""))
    person = (kind == "linkedin") & ~bare.rlike("^(?:in|company|school|pub)/")
    return F.concat(base, F.when(person, F.lit("in/")).otherwise(F.lit("")), bare)


def candidates(pages: DataFrame, keys: Sequence[str], want: Sequence[str] = FAMILIES,
               html: str = "html", url: str = "url", deobfuscate: bool = True,
               structured: bool = True, own_borders: bool = False) -> DataFrame:
    """All raw finds of the wanted families: one row per find."""
    if "all" in want:
        want = FAMILIES
    df = with_finds(pages, [*dict.fromkeys([*keys, url])], html, want, deobfuscate, structured, own_borders)
    found = df.select(*keys, F.col(url).alias("source_url"), F.explode("__finds").alias("__c"))
    return found.select(*keys, "source_url", "__c.*")


def contacts_of(pages: DataFrame, keys: Sequence[str] = ("page_id",),
                want: Sequence[str] = FAMILIES, html: str = "html", url: str = "url",
                blocklist: Sequence[str] = rules.EMAIL_BLOCKLIST,
                local_blocklist: Sequence[str] = rules.EMAIL_LOCAL_BLOCKLIST,
                deobfuscate: bool = True, structured: bool = True, org_key: str | None = None,
                dedup: bool = True, own_borders: bool = False) -> DataFrame:
    """Contacts of each page: keys, domain, kind, value, source_url, confidence, meta, place.

    ``org_key`` names a column holding the organisation of a page; without it
    the registrable domain of the page's URL is used.  ``dedup=False`` leaves
    repeats of a value within a page to a later merge and saves a shuffle.
    With ``own_borders`` plain addresses and numbers do not share the character
    between two of them (see ``phone_runs``), and are read from the page as it
    is written (see ``anchors.page_finds``).
    """
    if org_key == "host":
        pages, org_key = pages.withColumn("__org", host_of(F.col(url))), "__org"
    elif org_key is None:
        pages, org_key = pages.withColumn("__org", registrable_domain(F.col(url))), "__org"
    carried = [*dict.fromkeys([*keys, org_key])]
    found = candidates(pages, carried, want, html, url, deobfuscate, structured, own_borders)
    out = _judged(found, org_key, url, blocklist, local_blocklist, own_borders).select(
        *keys, F.col(org_key).alias("domain"), "kind", "value", "source_url", "confidence",
        "meta", "place")
    return page_dedup(out, keys) if dedup else out


def _judged(found: DataFrame, org: str, url: str, blocklist, local_blocklist, own_borders: bool = False) -> DataFrame:
    """Cleaned, valid candidates with confidence and meta."""
    kind, raw, tag = F.col("kind"), F.col("raw"), F.col("tag")
    mail, phone, ld = kind == "email", kind == "phone", tag == "jsonld"
    df = pin(found, "__mail", F.when(mail & (tag.isNull() | ~ld), tidy_email(raw)).when(mail, F.lower(raw)))
    df = df.withColumn("__tel", F.when(phone, raw))
    df = df.where(
        F.when(mail, is_valid_email(F.col("__mail"), blocklist, local_blocklist))
        .when(phone, F.lit(True))
        .otherwise(~F.lower(raw).isin(*rules.SOCIAL_RESERVED)))
    df = with_normalised_phone(df, "__tel", "__phone", tag == "text" if own_borders else None)
    value = (F.when(mail, F.col("__mail")).when(phone, F.col("__phone"))
             .otherwise(social_url(kind, raw)))
    page_domain = registrable_domain(F.col("source_url"))
    conf = (F.when(mail & ~F.coalesce(ld, F.lit(False)), email_confidence(
        F.col("__mail"), F.col("base"), F.col("source_url"), page_domain)).otherwise(F.col("base")))
    meta = F.map_filter(F.create_map(
        F.lit("role"), F.when(mail & ~F.coalesce(ld, F.lit(False)), is_role(F.col("__mail")).cast("string")),
        F.coalesce(F.when(mail & ~ld, tag), F.lit("source")),
        F.when(ld, "jsonld").when(mail & tag.isNotNull(), "true"),
        F.lit("raw"), F.when(phone & ~ld, F.substring(strip(F.col("__tel")), 1, 40)),
        F.lit("handle"), F.when(~mail & ~phone, raw)), lambda k, v: v.isNotNull())
    return (df.withColumns({"value": value, "confidence": conf, "meta": meta})
            .where("value is not null").drop("__mail", "__tel", "__phone"))


def page_dedup(contacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best find of each value on a page; the earliest wins ties."""
    best = F.min_by(F.struct("domain", "value", "source_url", "confidence", "meta", "place"),
                    F.struct(-F.col("confidence"), F.col("place")))
    return (contacts.groupBy(*keys, "kind", F.lower("value").alias("__v")).agg(best.alias("__b"))
            .select(*keys, "__b.domain", "kind", "__b.value", "__b.source_url", "__b.confidence",
                    "__b.meta", "__b.place"))
