"""Layout problems of pages measured at several widths: one line per problem, with the widths it shows at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = {"error": "not-measured", "overflow": "sideways", "edges": "edges", "small": "small-text", "tight": "tight-panel"}


def problems(measures: DataFrame, min_text: int = 14, min_gap: int = 16) -> DataFrame:
    """measures(url, ord, width, error, overflow, edges, small, tight): (url, rule, line), in order of first sight. The first width's message stands."""
    px = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    fine = measures.where("error is null or error = ''")
    row = lambda df, order, kind, key, message: df.select("url", F.struct(F.col("ord"), order).alias("at"), "width", F.lit(kind).alias("kind"), key.alias("key"), message.alias("message"))
    at = lambda a, b=F.lit(0): F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    error = row(measures.where("error != ''"), at(F.lit(0)), "error", F.col("error"), F.concat(F.lit("not measured: "), F.col("error")))
    element = F.col("overflow.element")
    wide = row(fine.where("overflow is not null"), at(F.lit(1)), "overflow", F.coalesce(element, F.lit("")), F.concat(F.lit("scrolls sideways by "), F.col("overflow.px").cast("string"), F.lit("px"), F.when(F.coalesce(element, F.lit("")) != "", F.concat(F.lit(", first past the edge: "), element)).otherwise("")))
    more = lambda bands: F.when(F.size(bands) > 3, F.concat(F.lit(" +"), (F.size(bands) - 3).cast("string"), F.lit(" more"))).otherwise("")
    group = F.array_join(F.transform("edges", lambda g: F.concat(g["x"].cast("string"), F.lit("px "), F.array_join(F.slice(g["bands"], 1, 3), ", "), more(g["bands"]))), "; ")
    edges = row(fine.where("size(edges) > 0"), at(F.lit(2)), "edges", F.to_json(F.transform("edges", lambda g: g["bands"])), F.concat(F.lit("left edges differ: "), group, F.lit("; put every band's content on one left edge")))
    tiny = fine.select("url", "ord", "width", F.posexplode("small").alias("pos", "t")).groupBy("url", "ord", "width", F.col("t.element").alias("element")).agg(F.min("pos").alias("pos"), F.count("*").alias("n"), F.min("t.px").alias("px"), F.min_by("t.text", "pos").alias("text"))
    again = F.when(F.col("n") > 1, F.concat(F.lit(" (+"), (F.col("n") - 1).cast("string"), F.lit(" more)"))).otherwise("")
    small = row(tiny, at(F.lit(3), F.col("pos")), "small", F.col("element"), F.concat(F.lit("text at "), px(F.col("px")), F.lit("px in <"), F.col("element"), F.lit('> "'), F.col("text"), F.lit('"'), again, F.lit(f"; {min_text}px is the smallest a reader needs")))
    near = fine.select("url", "ord", "width", F.posexplode("tight").alias("pos", "t")).select("url", "ord", "width", "pos", "t.*")
    tight = row(near, at(F.lit(4), F.col("pos")), "tight", F.concat("panel", F.lit("\x00"), "text"), F.concat(F.lit('"'), F.col("text"), F.lit('" is '), F.col("gap").cast("string"), F.lit("px from the "), F.col("side"), F.lit(" edge of <"), F.col("panel"), F.lit(f">, a panel with its own ground; give it at least {min_gap}px of padding")))
    found = error.unionByName(wide).unionByName(edges).unionByName(small).unionByName(tight)
    one = found.groupBy("url", "kind", "key").agg(F.min("at").alias("at"), F.min_by("message", "at").alias("message"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "width"))), lambda x: F.concat(x["width"].cast("string"), F.lit("px"))), ", ").alias("widths"))
    rules = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    return one.select("url", "at", F.element_at(rules, F.col("kind")).alias("rule"), F.concat("widths", F.lit(": "), "message").alias("line"))
