"""E-mail columns: cleaning, validity, role, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .. import rules
from .text import html_unescape, percent_decode, strip
from .urls import domain_of_host, is_contact_url


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def mail_domain(email: Column) -> Column:
    return F.regexp_extract(email, r"(?s)^[^@]*@(.*)$", 1)


def clean_email(raw: Column) -> Column:
    """Decode, strip surrounding punctuation, lower-case, cut at ``?``."""
    return tidy_email(html_unescape(percent_decode(raw)))


def tidy_email(text: Column) -> Column:
    """Strip surrounding punctuation of a decoded address, lower-case, cut at ``?``."""
    bare = F.regexp_replace(strip(text), r"""^[.,;:'"<>()\[\]]+|[.,;:'"<>()\[\]]+$""", "")
    return F.substring_index(F.lower(bare), "?", 1)


def is_valid_email(
    email: Column,
    blocklist: Sequence[str] = rules.EMAIL_BLOCKLIST,
    local_blocklist: Sequence[str] = rules.EMAIL_LOCAL_BLOCKLIST,
) -> Column:
    """False for images, versions, placeholders, vendor noise and unusable domains."""
    low = F.lower(email)
    local, domain = local_part(email), mail_domain(email)
    tld = F.substring_index(F.lower(domain), ".", -1)
    ok = (
        email.isNotNull() & (F.length(email) <= 254)
        & email.rlike(r"(?s)^[^@]+@[^@]+$")
        & ~email.contains("..") & ~email.startswith(".")
        & ~local.endswith(".") & ~domain.rlike(r"^-|[.\-]$")
        & ~domain.rlike("(?i)" + rules.IMAGE_TAIL) & ~domain.rlike(r"^(?:\d+\.){1,126}\d+$")
        & ~local.rlike(r"(?i)^[0-9a-f]{25,}$")
        & tld.rlike(r"^[a-z]{2,24}$") & ~tld.isin(*rules.BAD_EMAIL_TLDS)
        & ~low.rlike(r"@2x|@3x|sentry\.io|wixpress")
        & ~email.rlike("[%&]") & ~domain.contains("+"))
    if blocklist:
        ok = ok & ~F.lower(domain).isin(*blocklist) & ~domain_of_host(F.lower(domain)).isin(*blocklist)
    if local_blocklist:
        ok = ok & ~F.lower(local).isin(*local_blocklist)
    return F.coalesce(ok, F.lit(False))


def is_role(email: Column) -> Column:
    return F.lower(local_part(email)).isin(*rules.ROLE_LOCALS)


def is_freemail(email: Column) -> Column:
    return F.substring_index(email, "@", -1).isin(*rules.FREEMAIL)


def email_confidence(email: Column, base: Column, page_url: Column, page_domain: Column) -> Column:
    """Base confidence adjusted for role, own domain, contact page and webmail."""
    domain = mail_domain(email)
    score = (
        base
        + F.when(local_part(email).isin(*rules.ROLE_LOCALS), 0.05).otherwise(0.0)
        + F.when((page_domain != "") & (domain_of_host(domain) == page_domain), 0.20).otherwise(0.0)
        + F.when(is_contact_url(page_url), 0.10).otherwise(0.0)
        - F.when(F.substring_index(domain, ".", 1).isin(*rules.WEBMAIL_LABELS), 0.05).otherwise(0.0))
    return F.round(F.greatest(F.lit(0.05), F.least(score, F.lit(1.0))), 2)


def decode_cfemail(token: Column) -> Column:
    """Hex token XORed with its first byte back to text; null when not decodable."""
    even = F.length(token) >= 4
    key = F.conv(F.substring(token, 1, 2), 16, 10).cast("int")
    codes = F.transform(
        F.sequence(F.lit(3), F.greatest(F.length(token), F.lit(3)), F.lit(2)),
        lambda i: F.conv(F.substr(token, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key))
    return F.when(even, F.array_join(F.transform(codes, lambda n: F.char(n.cast("bigint"))), ""))
