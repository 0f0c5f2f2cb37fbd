"""Structured data, tracking and third-party pieces of a page, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import url as U

#: IDs of analytics and pixels (kind, pattern, group) and metas that verify a site.
TRACKING = (
    ("ga4", r"\bG-[A-Z0-9]{6,12}\b", 0),
    ("gtm", r"\bGTM-[A-Z0-9]{4,10}\b", 0),
    ("ua", r"\bUA-\d{4,10}-\d{1,3}\b", 0),
    ("meta_pixel", r"fbq\(\s*['\"]init['\"]\s*,\s*['\"](\d{6,20})['\"]", 1),
    ("meta_pixel", r"facebook\.com/tr\?id=(\d{6,20})", 1),
    ("hotjar", r"hjid\s*:\s*(\d{4,10})", 1),
    ("clarity", r"clarity\.ms/tag/([a-z0-9]{5,20})", 1),
    ("google_ads", r"\bAW-\d{6,12}\b", 0),
)
VERIFICATION = {"google-site-verification": "google_site_verification", "msvalidate.01": "bing_verification", "facebook-domain-verification": "facebook_domain_verification", "p:domain_verify": "pinterest_verification"}
#: What an embedded address belongs to; the first kind that fits.
EMBEDS = (
    ("map", ("google.com/maps", "maps.google", "openstreetmap.org", "mapbox.com")),
    ("booking", ("calendly.com", "acuityscheduling.com", "squareup.com/appointments", "setmore.com", "simplybook", "booksy.com", "vagaro.com", "housecallpro.com", "jobber.com", "servicetitan.com")),
    ("chat", ("intercom", "crisp.chat", "tawk.to", "drift.com", "hubspot.com/messaging", "js.hs-scripts.com", "tidio", "livechat", "zendesk.com", "podium.com")),
    ("reviews", ("trustpilot.com", "elfsight.com", "reviews.io", "yotpo.com", "birdeye.com", "widget.reviews", "google.com/reviews")),
    ("video", ("youtube.com", "youtu.be", "vimeo.com", "wistia", "loom.com")),
    ("form", ("typeform.com", "jotform.com", "hsforms.net", "forms.gle", "cognitoforms.com", "formstack.com")),
    ("social", ("facebook.com/plugins", "instagram.com/embed", "platform.twitter.com", "tiktok.com/embed")),
    ("payments", ("stripe.com", "paypal.com/sdk", "square.js")),
)
#: Hosts and words of links in headers and footers.
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.com", "threads.net", "yelp.com", "nextdoor.com", "g.page", "maps.google.com", "goo.gl", "tripadvisor.com", "houzz.com", "angi.com", "bbb.org")
LEGAL = r"(?i)privacy|terms|conditions|cookie|legal|refund|returns?\b|accessibility|disclaimer|gdpr|imprint|impressum"
CTA = r"(?i)\b(call|book|quote|estimate|contact|get started|schedule|appointment|order|buy|apply|sign up|enquire|inquire|request)\b"
BADGE = r"(?i)badge|award|accredit|certif|partner|bbb|rating|guarantee|seal|trust|payment|visa|mastercard|licen[cs]ed|insured|member"
COPYRIGHT = r"(?i)©|\(c\)|copyright|all rights reserved"


def tracking_ids(html: Column) -> Column:
    """Distinct (kind, value) in order of pattern and place."""
    named_as = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    found = [F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(g)), named_as(kind)) for kind, p, g in TRACKING]
    metas = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s+[^>]*name=[\"'][^\"']+[\"'][^>]*content=[\"'][^\"']+[\"']"), F.lit(0))
    named = F.transform(metas, lambda m: F.struct(F.lower(F.regexp_extract(m, r"(?i)name=[\"']([^\"']+)[\"']", 1)).alias("n"), F.regexp_extract(m, r"(?i)content=[\"']([^\"']+)[\"']$", 1).alias("v")))
    kinds = F.create_map(*[F.lit(x) for kv in VERIFICATION.items() for x in kv])
    verified = F.transform(F.filter(named, lambda m: m["n"].isin(*VERIFICATION)), lambda m: F.struct(F.element_at(kinds, m["n"]).alias("kind"), m["v"].alias("value")))
    return F.array_distinct(F.concat(*found, verified))


def embed_kind(src: Column) -> Column:
    s, out = F.lower(src), None
    for kind, hosts in EMBEDS:
        fits = s.rlike("|".join(h.replace(".", r"\.") for h in hosts))
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


def embeds(iframes: Column, scripts: Column) -> Column:
    """(kind, host, src) of each third-party source once, iframes first."""
    every = F.array_distinct(F.concat(iframes, scripts))
    kinds = F.transform(every, lambda s: F.struct(embed_kind(s).alias("kind"), U.host(s).alias("host"), s.alias("src")))
    return F.filter(kinds, lambda e: e["kind"].isNotNull())


def jsonld_items(raw: Column) -> Column:
    """Objects of the JSON-LD blocks as JSON strings: lists and graphs flattened, trailing commas forgiven, what does not parse left out."""
    t = F.trim(raw)
    parsed = F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_replace(t, r",\s*([}\]])", "$1")))
    listed = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>")).otherwise(F.array(parsed))
    objects = F.filter(F.coalesce(listed, F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    graph = lambda v: F.try_variant_get(v, "$['@graph']", "array<variant>")
    flat = F.flatten(F.transform(objects, lambda v: F.coalesce(graph(v), F.array(v))))
    return F.transform(F.filter(flat, lambda v: F.schema_of_variant(v).startswith("OBJECT")), lambda v: F.to_json(v))


def jsonld_types(items: Column) -> Column:
    """Distinct @type values of items (JSON strings) in order."""
    one = lambda j: F.coalesce(F.from_json(F.get_json_object(j, "$['@type']"), "array<string>"), F.array(F.get_json_object(j, "$['@type']")))
    return F.array_distinct(F.filter(F.flatten(F.transform(items, one)), lambda t: t.isNotNull()))


def open_graph(meta: Column) -> Column:
    return F.map_filter(meta, lambda k, v: k.rlike("^(og|twitter|article):"))


def is_social(href: Column) -> Column:
    h = U.site(href)
    return h.isin(*SOCIAL_HOSTS) | h.rlike(r"\.(" + "|".join(x.replace(".", r"\.") for x in SOCIAL_HOSTS) + ")$")


def is_legal(text: Column, href: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(LEGAL) | U.path(href).rlike(LEGAL)


def looks_like_cta(text: Column, classes: Column) -> Column:
    return F.array_join(classes, " ").rlike("btn|button|cta") | (F.coalesce(text, F.lit("")).rlike(CTA) & (F.char_length(F.coalesce(text, F.lit(""))) < 32))


def is_skip_link(text: Column, href: Column) -> Column:
    """Skip links and menu toggles."""
    t = F.lower(F.coalesce(text, F.lit("")))
    jump = (F.regexp_replace(U.path(href), "^/+|/+$", "") == "") & (U.fragment(href) != "")
    return t.startswith("skip ") | jump | t.rlike(r"^[^\p{L}\p{N}]*(menu|close|open|toggle)?[^\p{L}\p{N}]*\z")


def jsonld_items_all(raw: Column) -> Column:
    """Items of all JSON-LD blocks of a page, in order."""
    return F.flatten(F.transform(raw, jsonld_items))
