"""URLs as Column expressions. Parts are cut by one pattern, so nothing fails on odd hosts or spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track (by the start of their names), and extensions that are not pages.
TRACKING_PARAMS = ("utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "ref")
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx")
SKIP_EXTENSIONS = ("pdf", "zip", "jpg", "jpeg", "png", "gif", "webp", "svg", "mp4", "mp3", "css", "js", "ico", "xml", "json", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
LOCAL_HOSTS = ("localhost", "127.0.0.1")

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    clean = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    return F.regexp_extract(clean, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def host(url: Column) -> Column:
    """Host name in lower case, without user and port."""
    bare = F.regexp_replace(netloc(url), r"^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1)))


def site(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def site_of_host(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^www\.", "")


def same_site(url: Column, root_host: Column) -> Column:
    return site(url) == site_of_host(root_host)


def _quote(text: Column) -> Column:
    """Form encoding with `~` plain and `*` encoded, as RFC 3986 has it."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _unquote(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def parameters(q: Column) -> Column:
    """Name and value of each parameter, in order; empty ones left out."""
    parts = F.filter(F.split(q, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(_unquote(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("name"), _unquote(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value")))


def unsplit(scheme_: Column, netloc_: Column, path_: Column, query_: Column) -> Column:
    at = F.when((netloc_ != "") | (scheme_.isin("http", "https", "ftp", "file") & ~path_.startswith("//")), F.concat(F.lit("//"), netloc_, F.when((path_ != "") & ~path_.startswith("/"), F.concat(F.lit("/"), path_)).otherwise(path_))).otherwise(path_)
    return F.concat(F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""), at, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""))


def normalize(url: Column) -> Column:
    """One form per page: http(s) only, host in lower case without user and port, no fragment, no tracking parameters, no trailing slash; null otherwise."""
    tracks = lambda name: F.lower(name).rlike("^(" + "|".join(TRACKING_PARAMS) + ")")
    kept = F.filter(parameters(query(url)), lambda p: ~tracks(p["name"]))
    q = F.array_join(F.transform(kept, lambda p: F.concat(_quote(p["name"]), F.lit("="), _quote(p["value"]))), "&")
    p = path(url)
    p = F.when(p == "", F.lit("/")).when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)
    return F.when(scheme(url).isin("http", "https"), unsplit(scheme(url), host(url), p, q))


def _has_extension(url: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(extensions) + r")\z")


def crawlable(url: Column) -> Column:
    return ~_has_extension(url, SKIP_EXTENSIONS)


def is_document(url: Column) -> Column:
    return _has_extension(url, DOCUMENT_EXTENSIONS)


def local_http(url: Column) -> Column:
    return (scheme(url) == "http") & host(url).isin(*LOCAL_HOSTS)


def literal_ip_is_public(name: Column) -> Column:
    """For an IPv4 literal: not private, loopback, link-local, reserved; null for other hosts, whose addresses only a resolver knows."""
    four = F.regexp_extract(name, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", 0) != ""
    octet = lambda i: F.regexp_extract(name, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    a, b, c = octet(1), octet(2), octet(3)
    closed = (a.isin(0, 10, 127)) | (a >= 240) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return F.when(four, ~closed & (F.greatest(a, b, c, octet(4)) <= 255))


def public_http(url: Column) -> Column:
    """http(s) on a host that is not local by name or by literal address. A name that needs a resolver is null."""
    h = host(url)
    named = (h == "") | (h == "localhost") | h.rlike(r"\.(local|internal)$")
    return F.when(~scheme(url).isin("http", "https") | named, F.lit(False)).otherwise(literal_ip_is_public(h))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def section(url: Column) -> Column:
    """First segment of the path in lower case, empty for the home page."""
    return F.lower(F.coalesce(F.get(segments(url), 0), F.lit("")))


def _trim_slashes(p: Column) -> Column:
    return F.regexp_replace(p, "^/+|/+$", "")


def slugify(url: Column) -> Column:
    p = _trim_slashes(path(url))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.when(p == "", F.lit("index")).otherwise(p)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(slug == "", F.lit("index")).otherwise(slug), 1, 80)


def page_name(url: Column, hashed: bool = False) -> Column:
    """File stem of a page: its clean path with `--` for `/`, else slug and hash."""
    p = _trim_slashes(path(url))
    clean = p.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*(?:/[a-z0-9]+(?:-[a-z0-9]+)*)*\z") | (p == "")
    plain = (query(url) == "") & (F.char_length(p) <= 80) & clean & F.lit(not hashed)
    spelled = F.when(p == "", F.lit("index")).otherwise(F.replace(p, F.lit("/"), F.lit("--")))
    return F.when(plain, spelled).otherwise(F.concat(F.substring(slugify(url), 1, 70), F.lit("-"), F.substring(F.sha1(F.encode(url, "UTF-8")), 1, 8)))


def map_to(url: Column, base: Column) -> Column:
    """The same path and query on another base."""
    p = path(url)
    return unsplit(scheme(base), netloc(base), F.when(p == "", F.lit("/")).otherwise(p), query(url))


def audit_norm(url: Column) -> Column:
    """Identity in an audit: port, case and query kept, fragment and trailing slash dropped."""
    p = F.regexp_replace(path(url), "/+$", "")
    return unsplit(scheme(url), netloc(url), F.when(p == "", F.lit("/")).otherwise(p), query(url))


def path_key(url: Column) -> Column:
    p = F.regexp_replace(path(url), "/+$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)
