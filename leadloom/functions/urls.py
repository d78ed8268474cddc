"""URL columns: parts, registrable domain, canonical form, predicates, safety.

URLs are taken apart with the RFC 3986 appendix B expression rather than with
``parse_url``, which gives null for characters real pages use in links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from .text import html_unescape, pin, strip

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AFTER_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def _alternation(words: Sequence[str]) -> str:
    out = []
    for word in words:
        out.append("".join("\\" + ch if ch in ".-+/" else ch for ch in word))
    return "|".join(out)


def _tidy(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\t\r\n]", "")


def scheme_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(_tidy(c), _SCHEME, 1))


def netloc_of(c: Column) -> Column:
    return F.regexp_extract(_tidy(c), _AFTER_SCHEME + r"//([^/?#]*)", 1)


def path_of(c: Column) -> Column:
    return F.regexp_extract(_tidy(c), _AFTER_SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def query_of(c: Column) -> Column:
    return F.regexp_extract(_tidy(c), r"^[^?#]*\?([^#]*)", 1)


def host_of(c: Column) -> Column:
    """Lower-case host name without user info and port; '' when there is none."""
    raw = F.regexp_extract(
        _tidy(c), _AFTER_SCHEME + r"//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1)
    return F.lower(F.translate(raw, "[]", ""))


def origin_of(c: Column) -> Column:
    return F.concat(scheme_of(c), F.lit("://"), netloc_of(c))


_LAST_LABELS = (r"^(?![0-9.]*$)(?:.*?\.)??([^.]*\.(?:" + "|".join(rules.SECOND_LEVEL_LABELS)
                + r")\.[^.]{0,3}|[^.]*\.[^.]*)$")


def domain_of_host(host: Column) -> Column:
    """Registrable domain of a host: two labels, three under suffixes like ``co.uk``."""
    bare = F.regexp_replace(
        F.substring_index(F.substring_index(host, "@", -1), ":", 1), r"^\.+|\.+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), _LAST_LABELS, "$1")


def registrable_domain(c: Column) -> Column:
    """Registrable domain of a URL or of a bare host."""
    return domain_of_host(F.when(c.contains("//"), host_of(c)).otherwise(F.lower(F.trim(c))))


def same_site(a: Column, b: Column) -> Column:
    return registrable_domain(a) == registrable_domain(b)


def has_skipped_extension(url: Column) -> Column:
    return F.lower(path_of(url)).rlike("(?:" + _alternation(rules.SKIP_EXTENSIONS) + ")$")


def is_scrapeable(url: Column, skip_domains: Sequence[str] = rules.SKIP_DOMAINS) -> Column:
    """False for hosts and file kinds that never yield organisations."""
    domain = registrable_domain(url)
    ok = domain != ""
    if skip_domains:
        ok = ok & ~domain.isin(*skip_domains)
    return ok & ~has_skipped_extension(url)


def is_contact_url(url: Column) -> Column:
    return F.lower(url).rlike(_alternation(rules.CONTACT_HINTS[:rules.CONTACT_URL_HINT_COUNT]))


def is_sitemap_contact(url: Column) -> Column:
    return F.lower(url).rlike(_alternation(rules.SITEMAP_CONTACT_KEYWORDS))


def bare_domain(c: Column) -> Column:
    """Net location of a URL or of a bare domain."""
    netloc = netloc_of(F.when(c.contains("://"), c).otherwise(F.concat(F.lit("https://"), c)))
    return F.when(netloc != "", netloc).otherwise(c)


_IPV4 = (r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}"
         r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
_IPV6 = r"^(?=.*:)[0-9a-f:]+(?::(?:\d{1,3}\.){3}\d{1,3})?$"


def is_ip_literal(host: Column) -> Column:
    return host.rlike(_IPV4) | F.translate(host, "[]", "").rlike(_IPV6)


def is_public_domain(c: Column) -> Column:
    """False for addresses, localhost, ``.local`` and names without a dot."""
    host = F.lower(F.substring_index(bare_domain(c), ":", 1))
    return ((host != "localhost") & ~host.endswith(".local") & ~is_ip_literal(host)
            & host.contains("."))


def cache_key(url: Column) -> Column:
    """128-bit key of a URL."""
    return F.md5(url)


def with_private_flag(df: DataFrame, ip: str, out: str = "is_private") -> DataFrame:
    """Add whether an address is not on the public internet (IPv4, IPv6, mapped IPv4)."""
    c = F.col
    keep = list(df.columns)
    df = df.withColumn("__ip", F.lower(F.translate(c(ip), "[]", "")))
    df = df.withColumns({
        "__v4": F.nullif(F.regexp_extract(
            c("__ip"), r"^(?:::ffff:(?:0:)?)?((?:\d{1,3}\.){3}\d{1,3})$", 1), F.lit("")),
        "__hex": F.nullif(F.regexp_extract(
            c("__ip"), r"^::ffff:([0-9a-f]{1,4}:[0-9a-f]{1,4})$", 1), F.lit(""))})
    part = F.split(c("__v4"), r"\.").try_cast("array<bigint>")
    half = F.transform(F.split(c("__hex"), ":"), lambda h: F.conv(h, 16, 10).try_cast("bigint"))
    df = df.withColumns({"__dec": part, "__two": half}).withColumn("__num", F.coalesce(
        F.aggregate("__dec", F.lit(0).cast("bigint"), lambda n, x: n * 256 + x),
        F.aggregate("__two", F.lit(0).cast("bigint"), lambda n, x: n * 65536 + x)))
    inside = F.lit(False)
    for block in rules.PRIVATE_IPV4:
        start, bits = block.split("/")
        low = sum(int(p) << s for p, s in zip(start.split("."), (24, 16, 8, 0)))
        inside = inside | c("__num").between(low, low + (1 << (32 - int(bits))) - 1)
    inside = inside & ~F.coalesce(c("__v4").isin(*rules.PUBLIC_IPV4_EXCEPTIONS), F.lit(False))
    # Only 2000::/3 is global, and four blocks inside it are not.
    public_v6 = c("__ip").rlike(r"^[23][0-9a-f]{3}:") & ~c("__ip").rlike(
        r"^(?:2001:(?:[01]?[0-9a-f]{0,2}:|:|0?db8:)|2002:|3fff:0?[0-9a-f]{0,3}:)")
    return pin(df, out, F.when(c("__num").isNotNull(), inside).otherwise(~public_v6)).select(*keep, out)


def with_block_reason(df: DataFrame, url: str, out: str = "block_reason",
                      allow_private: bool = False) -> DataFrame:
    """Add why a URL must not be fetched; null when it may be."""
    c, u = F.col, F.col(url)
    keep = list(df.columns)
    df = df.withColumns({"__scheme": scheme_of(u), "__netloc": netloc_of(u),
                         "__host": F.regexp_replace(F.trim(host_of(u)), r"\.+$", "")})
    port_text = F.regexp_extract(F.substring_index(c("__netloc"), "@", -1),
                                 r"^(?:\[[^\]]*\]|[^:\[]*):(.+)$", 1)
    df = df.withColumn("__port", port_text).withColumn(
        "__number", F.when(c("__port").rlike(r"^\d{1,9}$"), c("__port")).try_cast("bigint"))
    host, port = c("__host"), c("__number")
    reason = (
        F.when(u.isNull() | (c("__netloc").contains("[") != c("__netloc").contains("]")), "malformed")
        .when(~c("__scheme").isin("http", "https"), "scheme")
        .when(host == "", "no host")
        .when((c("__port") != "") & (port.isNull() | (port > 65535)), "invalid port")
        .when(port.isin(*rules.BLOCKED_PORTS), "blocked port")
        .when(host.isin(*rules.METADATA_HOSTS), "metadata host"))
    if not allow_private:
        df = with_private_flag(df, "__host", "__private")
        suffixes = "(?:" + _alternation(rules.LOCAL_SUFFIXES) + ")$"
        reason = (reason.when(host.isin(*rules.LOCAL_NAMES) | host.rlike(suffixes), "local name")
                  .when(is_ip_literal(host) & c("__private"), "private address"))
    return pin(df, out, reason).select(*keep, out)


def with_normalised_url(df: DataFrame, url: str, out: str, base: str | None = None) -> DataFrame:
    """Add the canonical absolute form of a link; null when it is not a web link.

    Entities are decoded, the link is resolved against ``base``, the host is
    lower-cased, and default ports, fragments, tracking parameters, repeated
    and trailing slashes are dropped.  The work is split over projections so
    that no intermediate value is computed twice.
    """
    c = F.col
    keep = list(df.columns)
    df = df.withColumn("__u", _tidy(html_unescape(strip(c(url)))))
    if base is not None:
        df = df.withColumns({
            "__bs": scheme_of(c(base)), "__bn": netloc_of(c(base)),
            "__bp": path_of(c(base)), "__bq": query_of(c(base))})
    df = df.withColumns({
        "__s": scheme_of(c("__u")), "__n": netloc_of(c("__u")),
        "__p": path_of(c("__u")), "__q": query_of(c("__u"))})
    if base is not None:
        relative = ((c("__s") == "") | (c("__s") == c("__bs"))) & (c("__n") == "")
        other = (c("__s") != "") & (c("__s") != c("__bs"))
        folder = F.regexp_replace(c("__bp"), r"[^/]*$", "")
        joined = F.when(c("__p").startswith("/"), c("__p")).otherwise(
            F.concat(F.when(folder.startswith("/"), folder)
                     .otherwise(F.concat(F.lit("/"), folder)), c("__p")))
        df = df.withColumns({
            "__s": F.when(c("__s") == "", c("__bs")).otherwise(c("__s")),
            "__n": F.when(relative & ~other, c("__bn")).otherwise(c("__n")),
            "__q": F.when(relative & (c("__p") == "") & (c("__q") == ""), c("__bq"))
                    .otherwise(c("__q")),
            "__p": F.when(~relative, c("__p")).when(c("__p") == "", c("__bp"))
                    .otherwise(joined),
            "__rel": relative & (c("__p") != ""),
        })
        segments = F.split(F.regexp_replace(c("__p"), "/{2,}", "/"), "/")
        walked = F.aggregate(
            segments, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
        closing = F.when(c("__p").rlike(r"/\.\.?$"), F.concat(walked, F.array(F.lit("")))
                         ).otherwise(walked)
        df = df.withColumn("__p", F.when(
            c("__rel") & c("__p").rlike(r"/\.\.?(?:/|$)"), F.array_join(closing, "/"),
        ).otherwise(c("__p")))
    tracking = r"(?i)(?<![^&])(?:" + "|".join(rules.TRACKING_PREFIXES) + r")[^&]*"
    query = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c("__q"), tracking, ""), "&{2,}", "&"), "^&|&$", "")
    host = F.lower(c("__n"))
    df = df.withColumns({
        "__n": F.when(c("__s") == "http", F.regexp_replace(host, r":80$", ""))
                .when(c("__s") == "https", F.regexp_replace(host, r":443$", ""))
                .otherwise(host),
        "__q": query,
        "__p": F.regexp_replace(F.regexp_replace(
            F.concat(F.when(c("__p").startswith("/"), F.lit("")).otherwise(F.lit("/")), c("__p")),
            "/{2,}", "/"), r"(?<=.)/$", ""),
    })
    rejected = F.lit(False)
    for prefix in rules.REJECTED_HREF_PREFIXES:
        rejected = rejected | c("__u").startswith(prefix)
    usable = (~rejected & c("__s").isin("http", "https") & (c("__n") != "")
              & (c("__n").contains("[") == c("__n").contains("]")) & (c(url) != ""))
    return pin(df, out, F.when(usable, F.concat(
        c("__s"), F.lit("://"), c("__n"), c("__p"),
        F.when(c("__q") != "", F.concat(F.lit("?"), c("__q"))).otherwise(F.lit("")),
    ))).select(*keep, out)


def with_unwrapped_redirect(df: DataFrame, href: str, out: str, engine: str) -> DataFrame:
    """Add the target behind a search engine's redirect link.

    ``engine='duckduckgo'`` reads the ``uddg`` parameter; ``engine='bing'`` decodes
    the base64 ``u`` parameter and drops the engine's other links.
    """
    from .text import percent_decode

    keep = list(df.columns)
    df = df.withColumn("__h", html_unescape(F.col(href)))
    h = F.col("__h")
    if engine == "duckduckgo":
        absolute = F.when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(h)
        value = F.regexp_extract(absolute, r"[?&]uddg=([^&#]+)", 1)
        spaced = F.regexp_replace(value, r"\+", " ")
        target = F.when(value != "", percent_decode(spaced)).otherwise(absolute)
    elif engine == "bing":
        h = F.replace(h, F.lit("&amp;"), F.lit("&"))
        token = F.regexp_extract(h, rules.BING_REDIRECT, 1)
        decoded = F.try_to_binary(F.regexp_replace(token, "=+$", ""), F.lit("base64")).cast("string")
        own = netloc_of(h).contains("bing.com") & ~h.contains("/ck/a")
        target = (F.when(token != "", F.nullif(decoded, F.lit("")))
                  .when(own, F.lit(None).cast("string")).otherwise(h))
    else:
        raise ValueError(f"unknown engine {engine!r}")
    return with_normalised_url(df.withColumn("__t", target), "__t", out).select(*keep, out)
