"""Vendor payload readers: one JSON string column in, typed rows out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rules
from ..functions.emails import is_valid_email
from ..functions.phones import with_normalised_phone
from ..functions.text import clean_text, strip
from ..functions.urls import registrable_domain, with_normalised_url, with_unwrapped_redirect
from ..operators.contacts import social_url

SERP = ("organic_results array<struct<link:string,cached_page_link:string>>, "
        "local_results struct<places:array<struct<website:string>>>")
PLACES = ("results array<struct<place_id:string,name:string,formatted_address:string,"
          "geometry:struct<location:struct<lat:double,lng:double>>,rating:double,"
          "user_ratings_total:int,types:array<string>,business_status:string>>")
MAP_ELEMENT = ("type string, id bigint, lat double, lon double, "
               "center struct<lat:double,lon:double>, tags map<string,string>")
CONTACT_PROVIDER = (
    "data struct<domain:string,organization:string,country:string,industry:string,"
    "company_type:string,twitter:string,facebook:string,linkedin:string,instagram:string,"
    "emails:array<struct<value:string,confidence:int,first_name:string,last_name:string,"
    "position:string,department:string,verification:struct<status:string>>>>")
MX_ANSWER = "Status int, Answer array<struct<data:string>>"
PHONE_FACTS = ("success boolean, error struct<info:string>, valid boolean, country_name string, "
               "country_code string, location string, carrier string, line_type string, "
               "international_format string")
COMPANY_SEARCH = "search array<struct<id:string,label:string,description:string>>"
GEOCODE = "array<struct<boundingbox:array<string>>>"


def _set(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def serp_urls(payloads: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """Organic links, then the websites of local places, in canonical form."""
    p = payloads.withColumn("__p", F.from_json(payload, SERP))
    organic = F.transform(F.col("__p.organic_results"), lambda r: F.coalesce(
        _set(r["link"]), _set(r["cached_page_link"])))
    local = F.transform(F.col("__p.local_results.places"), lambda r: _set(r["website"]))
    none = F.array().cast("array<string>")
    raw = p.select(*keys, F.posexplode(F.array_compact(F.concat(
        F.coalesce(organic, none), F.coalesce(local, none)))).alias("seq", "__raw"))
    return with_normalised_url(raw, "__raw", "url").where("url is not null").drop("__raw")


def duckduckgo_urls(serps: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """Result links of a result page; any redirect link when there are no result anchors."""
    first = F.regexp_extract_all(html, F.lit(rules.DDG_RESULT), F.lit(1))
    other = F.regexp_extract_all(html, F.lit(rules.DDG_ANY), F.lit(1))
    raw = serps.select(*keys, F.posexplode(F.when(F.size(first) > 0, first).otherwise(other)).alias("seq", "__raw"))
    return with_unwrapped_redirect(raw, "__raw", "url", "duckduckgo").where("url is not null").drop("__raw")


def bing_urls(serps: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    raw = serps.select(*keys, F.posexplode(
        F.regexp_extract_all(html, F.lit(rules.BING_RESULT), F.lit(1))).alias("seq", "__raw"))
    return with_unwrapped_redirect(raw, "__raw", "url", "bing").where("url is not null").drop("__raw")


def until_short_page(pages: DataFrame, keys: Sequence[str], page: str = "page", hits: str = "n_hits",
                     minimum: int = 5) -> DataFrame:
    """Result pages up to and including the first with fewer than ``minimum`` hits."""
    stops = (pages.where(F.col(hits) < minimum).groupBy(*keys).agg(F.min(page).alias("__stop")))
    return (pages.join(stops, list(keys), "left")
            .where(F.col("__stop").isNull() | (F.col(page) <= F.col("__stop"))).drop("__stop"))


def place_rows(payloads: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """Result rows of a places search."""
    rows = payloads.select(*keys, F.posexplode(F.from_json(payload, PLACES)["results"]).alias("seq", "r"))
    r = F.col("r")
    return rows.select(
        *keys, "seq", r["place_id"].alias("place_id"), clean_text(r["name"], 120).alias("name"),
        clean_text(r["formatted_address"]).alias("address"),
        r["geometry"]["location"]["lat"].alias("latitude"), r["geometry"]["location"]["lng"].alias("longitude"),
        r["rating"].alias("rating"), r["user_ratings_total"].alias("reviews"),
        _set(F.array_join(F.slice(F.coalesce(r["types"], F.array().cast("array<string>")), 1, 3), ", ")
             ).alias("category"),
        r["business_status"].alias("business_status"))


def place_leads(places: DataFrame, details: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Places joined with their details by id: domain, canonical website, preferred phone.

    ``details``: place_id, website, formatted_phone_number, international_phone_number.
    """
    d = details.select("place_id", "website", F.coalesce(
        _set(F.col("international_phone_number")), _set(F.col("formatted_phone_number"))).alias("__phone"))
    df = places.join(d.dropDuplicates(["place_id"]), "place_id", "left")
    df = with_normalised_phone(with_normalised_url(df, "website", "__u"), "__phone", "phone")
    return df.select(
        *keys, "seq", "place_id", F.coalesce(registrable_domain(_set(F.col("website"))), F.lit("")).alias("domain"),
        F.coalesce("__u", F.lit("")).alias("url"), "name", "address", "latitude", "longitude", "rating",
        "reviews", "category", F.lit("places").alias("source"), "business_status", "phone",
        F.when(F.col("phone").isNotNull(), 0.95).alias("phone_confidence"))


def map_leads(payloads: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """Map elements with a name or website as leads; ``raw_phones``/``raw_emails`` keep the tag texts."""
    df = payloads.select(*keys, F.from_json(payload, MAP_ELEMENT).alias("e"))
    tags = F.col("e.tags")

    def tag(*names: str) -> Column:
        return F.coalesce(*[_set(F.try_element_at(tags, F.lit(n))) for n in names])

    parts = [_set(F.try_element_at(tags, F.lit("addr:" + n)))
             for n in ("housenumber", "street", "district", "city", "postcode", "country")]
    df = df.withColumns({
        "__site": tag("website", "contact:website", "url"),
        "name": clean_text(tag("name", "official_name", "name:en"), 120)})
    df = df.withColumn("__web", F.when(F.col("__site").contains("://"), F.col("__site")).otherwise(
        F.concat(F.lit("https://"), F.col("__site"))))
    df = with_normalised_url(df, "__web", "__u").where("name is not null or __site is not null")
    return df.select(
        *keys, F.coalesce(registrable_domain(_set(F.col("__u"))), F.lit("")).alias("domain"),
        F.coalesce("__u", F.lit("")).alias("url"), "name",
        clean_text(F.concat_ws(", ", *parts)).alias("address"),
        F.coalesce("e.lat", "e.center.lat").alias("latitude"),
        F.coalesce("e.lon", "e.center.lon").alias("longitude"),
        tag("amenity", "shop", "office", "tourism").alias("category"), F.lit("openstreetmap").alias("source"),
        F.col("e.id").alias("osm_id"), F.col("e.type").alias("osm_type"), tags.alias("tags"),
        tag("phone", "contact:phone", "contact:mobile").alias("raw_phones"),
        tag("email", "contact:email").alias("raw_emails"))


def map_contacts(leads: DataFrame, keys: Sequence[str],
                 blocklist: Sequence[str] = rules.EMAIL_BLOCKLIST) -> DataFrame:
    """Phones and e-mails of map leads; a tag may hold several, separated by ``;`` or ``,``."""
    def pieces(column: str, kind: str) -> DataFrame:
        return leads.select(*keys, F.col("url").alias("source_url"), F.lit(kind).alias("kind"),
                            F.posexplode(F.split(column, "[;,]")).alias("seq", "raw"))
    both = pieces("raw_phones", "phone").unionByName(pieces("raw_emails", "email"))
    both = with_normalised_phone(both, "raw", "__phone")
    mail = F.lower(strip(F.col("raw")))
    value = F.when(F.col("kind") == "phone", F.col("__phone")).when(
        is_valid_email(mail, blocklist), mail)
    return (both.withColumn("value", value).where("value is not null")
            .withColumn("confidence", F.when(F.col("kind") == "phone", 0.9).otherwise(0.85))
            .drop("raw", "__phone"))


def matches_selectors(tags: Column, selectors: Sequence[str]) -> Column:
    """True where a tag map has one of the ``key=value`` selectors (``yes``: any value)."""
    ok = F.lit(False)
    for selector in selectors:
        key, _, value = selector.partition("=")
        found = F.try_element_at(tags, F.lit(key))
        ok = ok | (found.isNotNull() if value == "yes" else F.coalesce(found == value, F.lit(False)))
    return ok


def provider_contacts(payloads: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """E-mails and social profiles of contact provider payloads (keys, domain, payload)."""
    df = payloads.withColumn("d", F.from_json(payload, CONTACT_PROVIDER)["data"])
    d = F.col("d")
    none = F.lit(None).cast("string")

    def meta(name: Column, position: Column, department: Column, verification: Column) -> Column:
        return F.map_filter(F.create_map(
            F.lit("source"), F.lit("hunter"), F.lit("name"), name, F.lit("position"), position,
            F.lit("department"), department, F.lit("verification"), verification),
            lambda k, v: v.isNotNull())

    mails = F.transform(
        F.filter(F.coalesce(d["emails"], F.array().cast(
            "array<struct<value:string,confidence:int,first_name:string,last_name:string,"
            "position:string,department:string,verification:struct<status:string>>>")),
            lambda e: F.coalesce(e["value"], F.lit("")) != ""),
        lambda e: F.struct(
            F.lit("email").alias("kind"), F.lower(e["value"]).alias("value"),
            # half up, in whole units of a ten-thousandth so that ties are exact
            (F.floor((F.least(F.lit(9900), 5000 + 50 * F.coalesce(
                F.nullif(e["confidence"], F.lit(0)), F.lit(50))) + 50) / 100) / 100.0).alias("confidence"),
            meta(_set(F.concat_ws(" ", _set(e["first_name"]), _set(e["last_name"]))), e["position"],
                 e["department"], e["verification"]["status"]).alias("meta")))
    socials = F.filter(F.array(*[
        F.struct(F.lit(k).alias("kind"),
                 F.when(d[k].startswith("http"), d[k]).otherwise(social_url(F.lit(k), _set(d[k]))).alias("value"),
                 F.lit(0.85).alias("confidence"), meta(none, none, none, none).alias("meta"))
        for k in ("twitter", "facebook", "linkedin", "instagram")]), lambda s: s["value"].isNotNull())
    rows = df.select(*keys, "domain", F.posexplode(F.concat(mails, socials)).alias("seq", "c"))
    return rows.select(*keys, "domain", "seq", "c.kind", "c.value", F.concat(F.lit("hunter:"), "domain").alias("source_url"),
                       "c.confidence", "c.meta")


def provider_profiles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Organisation fields of contact provider payloads: domain, name, country, industry, company_type."""
    d = F.from_json(payload, CONTACT_PROVIDER)["data"]
    return payloads.select("domain", d.alias("d")).where("d is not null").select(
        "domain", clean_text(F.col("d.organization"), 120).alias("name"),
        *[_set(F.col(f"d.{k}")).alias(k) for k in ("country", "industry", "company_type")])


def mx_hosts(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """MX hosts per domain from the first resolver that answered (domain, endpoint_rank, payload)."""
    parsed = answers.select("domain", "endpoint_rank", F.from_json(payload, MX_ANSWER).alias("a")).where("a.Status is not null or a.Answer is not null")
    texts = F.transform(F.col("a.Answer"), lambda r: F.rtrim(F.element_at(
        F.split(F.coalesce(_set(strip(r["data"])), F.lit(".")), r"\s+"), -1), F.lit(".")))
    hosts = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda h: h != "")
    return parsed.groupBy("domain").agg(F.min_by(hosts, "endpoint_rank").alias("mx_records"))


def phone_facts(payloads: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """Validation facts per number; refused requests are left out (see ``phone_errors``)."""
    p = payloads.select(*keys, F.from_json(payload, PHONE_FACTS).alias("p"))
    return p.where("p is not null and coalesce(p.success, true)").select(
        *keys, F.coalesce("p.valid", F.lit(False)).alias("valid"),
        F.coalesce(_set(F.col("p.country_name")), F.col("p.country_code")).alias("country"),
        "p.location", "p.carrier", "p.line_type", F.col("p.international_format").alias("international"))


def phone_errors(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Distinct messages of refused validation requests."""
    p = payloads.select(F.from_json(payload, PHONE_FACTS).alias("p")).where("p.success = false")
    return p.select(F.concat(F.lit("NumVerify: "), F.coalesce(
        "p.error.info", F.lit("NumVerify request failed"))).alias("message")).distinct()


def company_profiles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Top search hit per name when its description reads like an organisation (name, payload)."""
    top = F.get(F.from_json(payload, COMPANY_SEARCH)["search"], F.lit(0))
    p = payloads.where(F.length("name") >= 3).select("name", top.alias("t"))
    about = strip(F.col("t.description"))
    return p.where(about.rlike(r"(?iU)\b(?:" + rules.COMPANY_WORDS + ")")).select(
        "name", F.col("t.id").alias("wikidata_id"), F.col("t.label").alias("wikidata_label"),
        F.substring(about, 1, 120).alias("industry_hint"))


def geocoded_box(payload: Column) -> Column:
    """STRUCT<s,w,n,e> of the first hit of a geocoder, null when it has none."""
    box = F.transform(F.get(F.from_json(payload, GEOCODE), F.lit(0))["boundingbox"],
                      lambda x: x.try_cast("double"))
    good = (F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull())
    return F.when(good, F.struct(box[0].alias("s"), box[2].alias("w"), box[1].alias("n"), box[3].alias("e")))


def api_error(payload: Column) -> Column:
    """The error text in a vendor payload, null when it reports none."""
    v = F.try_parse_json(payload)

    def kind(x: Column) -> Column:
        return F.schema_of_variant(x)

    def text(path: str) -> Column:
        x = F.try_variant_get(v, path, "variant")
        return F.when(kind(x) == "STRING", _set(F.try_variant_get(v, path, "string")))

    status = text("$.status")
    return F.when(kind(v).startswith("OBJECT"), F.coalesce(
        text("$.error"), text("$.error.message"),
        *[text(f"$.errors[0].{k}") for k in ("details", "message", "detail", "id")], text("$.errors[0]"),
        text("$.error_message"), F.when(~status.isin("OK", "ZERO_RESULTS", "Success"), status)))
