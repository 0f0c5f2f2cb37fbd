"""Place details (one JSON document each) as flat facts, hours and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import business as B

#: Kinds of places as schema.org types.
SCHEMA_TYPES = {
    "bakery": "Bakery", "cafe": "CafeOrCoffeeShop", "coffee_shop": "CafeOrCoffeeShop", "restaurant": "Restaurant", "bar": "BarOrPub", "dentist": "Dentist", "doctor": "Physician",
    "pharmacy": "Pharmacy", "veterinary_care": "VeterinaryCare", "plumber": "Plumber", "electrician": "Electrician", "roofing_contractor": "RoofingContractor",
    "general_contractor": "GeneralContractor", "painter": "HousePainter", "locksmith": "Locksmith", "moving_company": "MovingCompany", "car_repair": "AutoRepair",
    "hair_salon": "HairSalon", "beauty_salon": "BeautySalon", "gym": "ExerciseGym", "florist": "Florist", "hotel": "Hotel", "lawyer": "Attorney", "accounting": "AccountingService",
    "insurance_agency": "InsuranceAgency", "real_estate_agency": "RealEstateAgent",
}
_TIME = "struct<day:int,hour:int,minute:int>"
DETAILS = f"""id string, displayName struct<text:string>, addressComponents array<struct<longText:string,shortText:string,types:array<string>>>, formattedAddress string,
nationalPhoneNumber string, internationalPhoneNumber string, websiteUri string, googleMapsUri string, location struct<latitude:double,longitude:double>,
regularOpeningHours struct<periods:array<struct<open:{_TIME},close:{_TIME}>>,weekdayDescriptions:array<string>>, timeZone struct<id:string>, businessStatus string,
primaryTypeDisplayName struct<text:string>, primaryType string, types array<string>, rating double, userRatingCount bigint, priceLevel string, editorialSummary struct<text:string>,
reviews array<struct<text:struct<text:string>,originalText:struct<text:string>,authorAttribution:struct<displayName:string,uri:string,photoUri:string>,publishTime:string,rating:double>>,
photos array<struct<name:string>>"""


def address_parts(components: Column) -> Column:
    c = F.coalesce(components, F.array().cast("array<struct<longText:string,shortText:string,types:array<string>>>"))
    text = lambda x: F.coalesce(F.nullif(x["longText"], F.lit("")), x["shortText"], F.lit(""))
    short = lambda x: F.coalesce(F.nullif(x["shortText"], F.lit("")), x["longText"], F.lit(""))
    of = lambda kinds, pick, at: F.coalesce(F.try_element_at(F.filter(F.transform(F.filter(c, lambda x: F.arrays_overlap(x["types"], F.array(*[F.lit(k) for k in kinds]))), pick), lambda t: t != ""), F.lit(at)), F.lit(""))
    number, route = of(["street_number"], text, -1), of(["route"], text, -1)
    street = F.array_join(F.filter(F.array(number, route), lambda x: x != ""), " ")
    return F.struct(street.alias("street"), of(["locality", "postal_town"], text, 1).alias("locality"), of(["administrative_area_level_1"], short, -1).alias("region"), of(["postal_code"], text, -1).alias("postal_code"), of(["country"], short, -1).alias("country"))


def opening_hours(periods: Column) -> Column:
    """Lines in day order; a place that never closes is one line; the week of periods starts on Sunday."""
    p = F.coalesce(periods, F.array().cast(f"array<struct<open:{_TIME},close:{_TIME}>>"))
    two = lambda n: F.lpad(F.coalesce(n, F.lit(0)).cast("string"), 2, "0")
    clock = lambda t: F.concat(two(t["hour"]), F.lit(":"), two(t["minute"]))
    read = F.transform(F.filter(p, lambda x: x["open"]["day"].isNotNull()), lambda x: F.struct(((x["open"]["day"] + 6) % 7).alias("day"), F.when(x["close"].isNull(), F.lit("00:00-23:59")).otherwise(F.concat(clock(x["open"]), F.lit("-"), clock(x["close"]))).alias("time")))
    by_day = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.try_element_at(F.filter(read, lambda r: r["day"] == d), F.lit(-1))["time"])
    always = (F.size(p) == 1) & F.get(p, 0)["close"].isNull() & (F.coalesce(F.get(p, 0)["open"]["hour"], F.lit(0)) == 0)
    return F.when(always, F.array(F.lit("Mo-Su 00:00-23:59"))).otherwise(F.get(F.transform(F.array(by_day), B.runs), 0))


def schema_type(primary: Column, types: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SCHEMA_TYPES.items() for x in kv])
    every = F.filter(F.concat(F.array(primary), F.coalesce(types, F.array().cast("array<string>"))), lambda t: F.coalesce(t, F.lit("")) != "")
    mapped = F.transform(every, lambda t: F.coalesce(F.try_element_at(known, t), F.when(t.endswith("_restaurant"), F.lit("Restaurant"))))
    return F.coalesce(F.get(F.filter(mapped, lambda t: t.isNotNull()), 0), F.lit(""))


def summarize(places: DataFrame, details: str = "details") -> DataFrame:
    """places with a column of place JSON: one flat row each."""
    d = places.select(F.from_json(details, DETAILS).alias("d")).select("d.*")
    or_empty = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    quote = lambda r: F.trim(F.coalesce(F.nullif(r["text"]["text"], F.lit("")), r["originalText"]["text"], F.lit("")))
    author = lambda r, f: F.coalesce(r["authorAttribution"][f], F.lit(""))
    reviews = F.transform(
        F.filter(F.coalesce("reviews", F.array().cast(d.schema["reviews"].dataType)), lambda r: quote(r) != ""),
        lambda r: F.struct(quote(r).alias("quote"), F.trim(author(r, "displayName")).alias("name"), F.lit("Google").alias("platform"), F.substring(F.coalesce(r["publishTime"], F.lit("")), 1, 10).alias("date"), r["rating"].alias("stars"), author(r, "uri").alias("url"), author(r, "photoUri").alias("photo")),
    )
    none = F.array().cast("array<string>")
    return d.select(
        or_empty("id").alias("place_id"), or_empty("displayName.text").alias("name"), address_parts(F.col("addressComponents")).alias("address"), or_empty("formattedAddress").alias("formatted_address"),
        or_empty("nationalPhoneNumber", "internationalPhoneNumber").alias("telephone"), or_empty("websiteUri").alias("website"), or_empty("googleMapsUri").alias("maps_url"),
        F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lng"), opening_hours(F.col("regularOpeningHours.periods")).alias("opening_hours"),
        F.coalesce("regularOpeningHours.weekdayDescriptions", none).alias("opening_hours_text"), or_empty("timeZone.id").alias("time_zone"), or_empty("businessStatus").alias("status"),
        or_empty("primaryTypeDisplayName.text", "primaryType").alias("primary_type"), schema_type(F.col("primaryType"), F.col("types")).alias("schema_type"), F.coalesce("types", none).alias("types"),
        "rating", F.col("userRatingCount").alias("review_count"), or_empty("priceLevel").alias("price_level"), or_empty("editorialSummary.text").alias("summary"), reviews.alias("reviews"),
        F.coalesce(F.size("photos"), F.lit(0)).alias("photos"),
    )
