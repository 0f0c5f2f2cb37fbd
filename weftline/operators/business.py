"""One business record per site from its JSON-LD, and the business card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import business as B

#: Types and fields of a business.
TYPES = (
    "LocalBusiness Organization Store Restaurant Dentist Plumber Electrician RoofingContractor HomeAndConstructionBusiness MedicalBusiness LegalService "
    "AutoRepair HairSalon BeautySalon Hotel RealEstateAgent ProfessionalService FinancialService Physician Attorney FoodEstablishment Corporation"
).split()
FIELDS = (
    "name legalName alternateName url telephone email address geo openingHours openingHoursSpecification sameAs image logo priceRange areaServed "
    "description founder foundingDate hasMap aggregateRating"
).split()
UNIONS = ("sameAs", "image")
PHOTOS = 16


def _get(field: str):
    return F.get_json_object("item", f"$['{field}']")


def eligible(items: DataFrame) -> DataFrame:
    """items(site, url, ord, pos, item): those of a business by type, or with telephone and address."""
    types = F.coalesce(F.from_json(_get("@type"), "array<string>"), F.array(_get("@type")))
    named = F.exists(types, lambda t: F.coalesce(t.isin(*TYPES) | t.rlike("(Business|Store|Service|Shop)$"), F.lit(False)))
    return items.withColumn("types", F.filter(types, lambda t: t.isNotNull())).where(named | (_get("telephone").isNotNull() & _get("address").isNotNull()))


def fields(items: DataFrame) -> DataFrame:
    """(site, field, ord, value, urls) of eligible items: a field's first value; sameAs and image keep all distinct ones, in order."""
    each = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), _get(f).alias("value")) for f in FIELDS]), lambda x: x["value"].isNotNull())
    rows = eligible(items).select("site", "url", "ord", "pos", F.explode(each).alias("f")).select("site", "url", "ord", "pos", "f.*")
    union = F.col("field").isin(*UNIONS)
    listed = F.when(union, F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).otherwise(F.array("value"))
    rows = rows.select("site", "url", "ord", "pos", "field", F.posexplode(listed).alias("sub", "value"))
    at = F.struct("ord", "pos", "sub")
    first = rows.groupBy("site", "field", "value").agg(F.min(at).alias("at"), F.min_by("url", at).alias("url"))
    one = first.where(~union).groupBy("site", "field").agg(F.min(F.struct("at", "value", "url")).alias("m")).select("site", "field", "m.*")
    return one.unionByName(first.where(union)).select("site", "field", "at", "value", "url")


def merge(items: DataFrame) -> DataFrame:
    """One row per site: map of field to value (JSON lists for unions), map of field to source pages, distinct types in order."""
    f = fields(items)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c])
    grouped = f.groupBy("site", "field").agg(ordered("value").alias("values"), F.array_distinct(ordered("url")).alias("urls"))
    value = F.when(F.col("field").isin(*UNIONS), F.to_json("values")).otherwise(F.get("values", 0))
    maps = grouped.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("field", value))).alias("fields"), F.map_from_entries(F.collect_list(F.struct("field", "urls"))).alias("sources"))
    typed = eligible(items).select("site", F.struct("ord", "pos").alias("at"), F.posexplode("types").alias("sub", "type"))
    types = typed.groupBy("site", "type").agg(F.min(F.struct("at", "sub")).alias("at")).groupBy("site").agg(ordered("type").alias("types"))
    return maps.join(types, "site", "left")


def address(field) -> object:
    """struct(street, locality, region, postal_code, country) of an address in markup: an object or a line."""
    g = lambda p: F.coalesce(F.get_json_object(field, p), F.lit(""))
    country = F.coalesce(F.get_json_object(field, "$.addressCountry.name"), F.get_json_object(field, "$.addressCountry"), F.lit(""))
    whole = F.struct(g("$.streetAddress").alias("street"), g("$.addressLocality").alias("locality"), g("$.addressRegion").alias("region"), g("$.postalCode").alias("postal_code"), country.alias("country"))
    return F.when((g("$.streetAddress") != "") | (g("$.addressLocality") != ""), whole).when(~field.startswith("{"), B.us_line(field))


def card(homes: DataFrame, business: DataFrame, facts: DataFrame) -> DataFrame:
    """homes(site, title, meta_description) ⟕ business ⟕ facts: one card per site. Telephone and mail come from the pages before the markup, all else from the markup first; `sources` names the winner of each field."""
    ranked = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "value")))), lambda x: x["value"])
    told = facts.groupBy("site").agg(*[ranked(k).alias(f"f_{k}") for k in ("phone", "email", "address", "hours", "social")])
    b = homes.join(business, "site", "left").join(told, "site", "left")
    field = lambda n: F.nullif(F.try_element_at("fields", F.lit(n)), F.lit(""))
    fact = lambda k: F.get(f"f_{k}", 0)
    listed = lambda n: F.coalesce(F.from_json(field(n), "array<string>"), F.when(field(n).isNotNull(), F.array(field(n))), F.array().cast("array<string>"))
    marked, line = address(field("address")), B.us_line(fact("address"))
    schema = F.filter(listed("openingHours"), lambda h: h.rlike(B.SCHEMA_HOURS))
    read = B.schema_hours(F.coalesce("f_hours", F.array().cast("array<string>")))
    place, title_name = F.coalesce(marked, line), B.name_from_title(F.col("title"), F.col("site"))
    socials = F.concat(F.coalesce("f_social", F.array().cast("array<string>")), listed("sameAs"))
    said = {
        "name": F.when(field("name").isNotNull(), "markup").when(title_name != "", "title").otherwise("host"),
        "telephone": F.when(fact("phone").isNotNull(), "facts").when(field("telephone").isNotNull(), "markup"),
        "email": F.when(fact("email").isNotNull(), "facts").when(field("email").isNotNull(), "markup"),
        "address": F.when(marked.isNotNull(), "markup").when(line.isNotNull(), "facts"),
        "opening_hours": F.when(F.size(schema) > 0, "markup").when(F.size(read) > 0, "facts"),
        "description": F.when(field("description").isNotNull(), "markup").when(F.col("meta_description") != "", "inventory"),
    }
    sources = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in said]), F.array(*said.values())), lambda k, v: v.isNotNull())
    return b.select(
        "site", F.coalesce(field("name"), F.nullif(title_name, F.lit("")), "site").alias("name"), F.coalesce(fact("phone"), field("telephone")).alias("telephone"),
        F.coalesce(fact("email"), field("email")).alias("email"), place.alias("address"), F.coalesce(B.time_zone(place["region"], place["country"]), F.lit("")).alias("time_zone"),
        F.when(F.size(schema) > 0, schema).otherwise(read).alias("opening_hours"), B.profiles(socials).alias("same_as"),
        F.coalesce(field("description"), F.nullif(F.col("meta_description"), F.lit(""))).alias("description"), sources.alias("sources"),
    )
