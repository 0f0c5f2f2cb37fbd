"""Pictures: identity across sizes, kind, file names; as Column expressions, but for reading sizes off bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import url as U
from .vectorised import vectorised

#: Words, hosts, patterns and limits by which pictures are told apart.
STOCK_HOSTS = ("unsplash.com", "pexels.com", "shutterstock.com", "istockphoto.com", "gettyimages", "pixabay.com", "adobestock", "freepik.com", "dreamstime.com", "depositphotos")
STOCK_NAME = r"(?i)shutterstock|istock|adobestock|gettyimages|depositphotos|stock-photo|pexels|unsplash"
ICON_WORDS = r"(?i)icon|sprite|arrow|chevron|bullet|check|star|social|favicon"
THEME = r"(?i)/themes?/|/theme-assets/|/assets/(img|images)/(bg|pattern|texture|placeholder)|placeholder|pattern|texture|/plugins/"
SOCIAL_PICTURE = r"(?i)facebook|instagram|twitter|linkedin|youtube|tiktok|pinterest|whatsapp|(?<![a-z])x-logo"
AVATAR = r"(?i)avatar|profile|gravatar|headshot|user-?photo|reviewer"
MARK_DIRECTORY = r"(?i)/(partners?|clients?|logos?|sponsors?|memberships?|certifications?|accreditations?|affiliations?|associations?)/"
MARK_WORDS = r"(?i)(?<![a-z])(badges?|seals?|bbb|accredit[\p{L}\p{N}_]*|certified|certification|sponsors?|as-seen-on)(?![a-z])"
SIZE_PARAMS = ("w", "h", "width", "height", "fit", "crop", "resize", "quality", "q", "format", "fm", "auto", "dpr", "s", "sz", "size")
WP_SIZE = r"(?i)-(\d{2,5})x(\d{2,5})(?=\.[a-z0-9]{2,5}$)|-scaled(?=\.[a-z0-9]{2,5}$)|@\dx(?=\.[a-z0-9]{2,5}$)"
SHOPIFY_SIZE = r"(?i)_(?:\d{2,5}x\d{0,5}|x\d{2,5}|small|medium|large|grande|compact|thumb|icon|master)(?:@\dx)?(?=\.[a-z0-9]{2,5}$)"
DRUPAL_STYLE = r"(?i)^(.*?/files)/styles/[^/]+/(?:public|private)/(.+?\.(?:jpe?g|png|gif|webp|avif))(?:\.webp)?$"
CLOUDINARY = r"(?i)^(/[^/]+/(?:image|video)/upload)/((?:[^/]*[,_][^/]*/)*)(v\d+/)?(.+\.(?:jpe?g|png|webp|gif|avif))$"
WIX = r"(?i)^(.*?\.(?:jpe?g|png|webp|gif))/v1/"
IMAGE_TYPES = {"image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/avif": "avif", "image/svg+xml": "svg", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico", "video/mp4": "mp4", "video/webm": "webm", "video/quicktime": "mov"}
MARKS_KEPT, VIDEOS_KEPT, BRAND_PHOTOS, GALLERY_MIN, GALLERY_PHOTOS = 40, 3, 60, 6, 40


def unwrapped(src: Column) -> Column:
    """The picture inside a resizing endpoint's URL."""
    inner = F.get(F.transform(F.filter(U.parameters(U.query(src)), lambda p: (p["name"] == "url") & (p["value"] != "")), lambda p: p["value"]), 0)
    inner = F.when(inner.startswith("/"), U.unsplit(U.scheme(src), U.netloc(src), inner, F.lit(""))).otherwise(inner)
    return F.when(U.path(src).rlike(r"/_(next|vercel)/image$"), F.coalesce(inner, src)).otherwise(src)


def variant(src: Column) -> Column:
    """struct(key, original): the picture's identity over all sizes, and the URL that should be its full size. Endpoints nested up to twice are unwrapped."""
    u = unwrapped(unwrapped(src))

    def parts(s: Column) -> Column:
        h, p = U.host(s), U.path(s)
        cloud = h.endswith("cloudinary.com") & (F.regexp_extract(p, CLOUDINARY, 4) != "")
        drupal, wix = F.regexp_extract(p, DRUPAL_STYLE, 2) != "", F.regexp_extract(p, WIX, 1) != ""
        bare = F.regexp_replace(F.regexp_replace(p, WP_SIZE, ""), SHOPIFY_SIZE, "")
        left = F.filter(U.parameters(U.query(s)), lambda x: ~F.lower(x["name"]).isin(*SIZE_PARAMS))
        q = F.array_join(F.transform(left, lambda x: F.concat(x["name"], F.lit("="), x["value"])), "&")
        clean = F.when(cloud, F.concat(F.regexp_extract(p, CLOUDINARY, 1), F.lit("/"), F.regexp_extract(p, CLOUDINARY, 4)))
        clean = clean.when(drupal, F.concat(F.regexp_extract(p, DRUPAL_STYLE, 1), F.lit("/"), F.regexp_extract(p, DRUPAL_STYLE, 2)))
        clean = clean.when(wix, F.regexp_extract(p, WIX, 1)).otherwise(bare)
        kept = F.when(cloud | drupal | wix, F.lit("")).otherwise(q)
        key = F.lower(F.concat(h, clean, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))
        return F.struct(key.alias("key"), U.unsplit(U.scheme(s), U.netloc(s), clean, kept).alias("original"))

    return F.get(F.transform(F.array(u), parts), 0)


def guess_kind(src: Column, alt: Column, width: Column, height: Column, landmark: Column, shown: Column, row: Column) -> Column:
    """What a picture probably is; the first rule that fits decides."""
    s, a = F.lower(F.coalesce(src, F.lit(""))), F.lower(F.coalesce(alt, F.lit("")))
    p, h = U.path(s), U.host(s)
    name = F.element_at(F.split(p, "/"), -1)
    both, jpeg = F.concat(name, F.lit(" "), a), p.rlike(r"\.jpe?g$")
    w0, h0 = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    sized, chrome = (w0 > 0) & (h0 > 0), F.coalesce(landmark, F.lit("")).isin("header", "footer")
    shown0 = F.coalesce(shown, F.lit(0))
    photo = s.rlike(r"\.(jpg|jpeg|webp|avif|heic)$") | s.contains("upload") | s.contains("photo") | s.contains("gallery")
    return (
        F.when(name.contains("logo") | a.contains("logo"), "logo")
        .when(sized & (w0 <= 64) & (h0 <= 64), "icon")
        .when(name.rlike(MARK_WORDS) | a.rlike(MARK_WORDS) | p.rlike(MARK_DIRECTORY), "mark")
        .when((F.coalesce(row, F.lit(0)) >= 3) & ~both.rlike(SOCIAL_PICTURE) & ~both.rlike(AVATAR), "mark")
        .when(sized & (h0 <= 200) & (2 * h0 <= w0) & (w0 <= 1000) & ~jpeg, "mark")
        .when((shown0 > 0) & (shown0 <= 260) & (a == "") & ~jpeg & (((w0 > 0) & (w0 > shown0)) | p.endswith(".svg")), "mark")
        .when(chrome & sized & (F.greatest(w0, h0) <= 400) & (a == "") & ~jpeg, "mark")
        .when(p.endswith(".svg") | name.rlike(ICON_WORDS), "icon")
        .when(h.rlike("|".join(x.replace(".", r"\.") for x in STOCK_HOSTS)) | s.rlike(STOCK_NAME), "stock")
        .when(s.rlike(THEME) | (chrome & (a == "")), "theme")
        .when(photo | (a != ""), "photo")
        .otherwise("theme")
    )


def widest(srcset: Column) -> Column:
    """URL of the widest candidate, the first of equals."""
    ranked = F.transform(srcset, lambda c, i: F.struct(F.coalesce(c["w"], F.lit(0)).alias("w"), (-i).alias("i"), c["url"].alias("url")))
    return F.array_max(ranked)["url"]


def candidates(original: Column, srcset: Column, seen: Column) -> Column:
    """URLs to try for the largest version, best first."""
    return F.array_distinct(F.filter(F.concat(F.array(original, widest(srcset)), F.reverse(seen)), lambda x: x.isNotNull() & (x != "")))


def extension(content_type: Column, src: Column) -> Column:
    kind = F.lower(F.trim(F.get(F.split(F.coalesce(content_type, F.lit("")), ";"), 0)))
    known = F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv])
    last = F.element_at(F.split(U.path(src), "/"), -1)
    ext = F.lower(F.regexp_extract(last, r"\.([A-Za-z0-9]{2,5})$", 1))
    return F.coalesce(F.try_element_at(known, kind), F.when(ext != "", ext), F.lit("img"))


def file_name(key: Column, original: Column, ext: Column) -> Column:
    last = F.coalesce(F.try_url_decode(F.replace(F.element_at(F.split(U.path(original), "/"), -1), F.lit("+"), F.lit("%2B"))), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(last, r"(?s)\.[^.]*$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    stem = F.substring(stem, 1, 40)
    return F.concat(F.when(stem == "", F.lit("image")).otherwise(stem), F.lit("-"), F.substring(F.sha1(F.encode(key, "UTF-8")), 1, 8), F.lit("."), ext)


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, WebP or JPEG file."""
    if not data:
        return None
    big, little = (lambda at, n: int.from_bytes(data[at : at + n], "big")), (lambda at, n: int.from_bytes(data[at : at + n], "little"))
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return (big(16, 4), big(20, 4)) if len(data) >= 24 else None
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return (little(6, 2), little(8, 2)) if len(data) >= 10 else None
    if data.startswith(b"RIFF") and data[8:12] == b"WEBP":
        form = data[12:16]
        if len(data) < 30 and form != b"VP8L" or len(data) < 25:
            return None
        if form == b"VP8 ":
            return little(26, 2) % 16384, little(28, 2) % 16384
        if form == b"VP8L":
            packed = little(21, 4)
            return packed % 16384 + 1, packed // 16384 % 16384 + 1
        return (little(24, 3) + 1, little(27, 3) + 1) if form == b"VP8X" else None
    if data.startswith(b"\xff\xd8"):
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
            elif 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                return big(at + 7, 2), big(at + 5, 2)
            else:
                at += 2 + big(at + 2, 2)
    return None


@vectorised("struct<width:int,height:int>")
def dimensions(data: pd.Series) -> pd.DataFrame:
    found = [size_of(d) or (None, None) for d in data]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")
