"""A deterministic fictional corpus: companies, their makers, documents about them, facts and questions.

Everything follows from a row number, so any size is a range of numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = "Alder Brisk Cinder Dapple Ember Fallow Gravel Hollow Isle Jasper Kelp Larch Mallow Nettle Onyx Pewter Quarry Russet Sorrel Thistle Umber Velvet Willow Yarrow Zephyr".split()
SECOND = "Forge Mills Optics Yards Works Looms Foundry Glass Marine Signals".split()
GIVEN = "Anneke Bertil Corin Dagny Eamon Freya Gideon Hedda Ivo Jonna Kaspar Linnea".split()
FAMILY = "Aster Birch Carrow Dunmore Elwood Farrow Grieg Holm Ingram Jarvis Kestrel Lund Moss".split()
CITIES = ("Tarnwick", "Osby", "Lindhaven", "Marrow Bay", "Skelby", "Port Aldous")
SCHOOLS = ("Osby Polytechnic", "University of Skelby", "Lindhaven College")
TRADES = ("ceramics company", "optics company", "shipping business", "weaving company")


def pick(options, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (n % len(options) + 1).cast("int"))


def companies(spark: SparkSession, n: int = 25) -> DataFrame:
    """``i, company, founder, year, city, born, school, trade, product``; names repeat no earlier than after 250 companies."""
    i = F.col("i")
    # Beyond the combinations a number tells names apart.
    name = F.concat_ws(" ", pick(FIRST, i), pick(SECOND, F.floor(i / len(FIRST))), F.when(i >= 250, F.floor(i / 250).cast("string")))
    person = F.concat_ws(" ", pick(GIVEN, i), pick(FAMILY, i * 5 + F.floor(i / 12)), F.when(i >= 150, F.floor(i / 150).cast("string")))
    return spark.range(n).withColumnRenamed("id", "i").select(
        "i", name.alias("company"), person.alias("founder"), (1950 + i * 7 % 70).cast("string").alias("year"), pick(CITIES, i * 3 + 1).alias("city"), pick(CITIES, i + 2).alias("born"), pick(SCHOOLS, i).alias("school"), pick(TRADES, i).alias("trade"), F.concat(pick(FIRST, i + 7), F.lit("-"), (i + 100).cast("string")).alias("product"),
    )


def documents(c: DataFrame) -> DataFrame:
    """Two documents for each company: one about it, one about its maker."""
    about = F.concat_ws(" ", "company", F.lit("was founded by"), "founder", F.lit("in"), F.concat("year", F.lit(".")), F.lit("It is headquartered in"), F.concat("city", F.lit(".")), F.lit("It is best known for the"), F.concat("product", F.lit(".")))
    maker = F.concat_ws(" ", "founder", F.lit("was born in"), F.concat("born", F.lit(".")), F.lit("They studied at"), F.concat("school", F.lit(".")))
    return c.select((F.col("i") * 2).alias("doc_id"), about.alias("text")).union(c.select((F.col("i") * 2 + 1).alias("doc_id"), maker.alias("text")))


def entities(c: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    one = lambda prefix, name, kind: c.select(F.concat(F.lit(prefix), F.col("i").cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"), none.alias("aliases"))
    return one("co:", "company", "company").union(one("pe:", "founder", "person"))


def facts(c: DataFrame) -> DataFrame:
    k = F.col("i").cast("string")
    co, pe = F.concat(F.lit("co:"), k), F.concat(F.lit("pe:"), k)
    none = F.lit(None).cast("string")
    stated = [("was founded by", co, pe, none), ("founded", pe, co, none), ("was founded in", co, none, F.col("year")), ("is headquartered in", co, none, F.col("city")), ("is best known for", co, none, F.col("product")), ("is", co, none, F.col("trade")), ("was born in", pe, none, F.col("born")), ("studied at", pe, none, F.col("school"))]
    out = None
    for n, (predicate, s, o, v) in enumerate(stated):
        rows = c.select(F.concat(F.lit(f"f{n}:"), k).alias("id"), s.alias("subject_id"), F.lit(predicate).alias("predicate"), o.alias("object_id"), v.alias("object_value"), F.lit(0.9).alias("confidence"), F.lit(True).alias("is_active"))
        out = rows if out is None else out.union(rows)
    return out


def questions(c: DataFrame, every: int = 1) -> DataFrame:
    """``qid, text, expected, hops``: six questions for each company, a third of them over two facts."""
    ask = [
        (1, F.concat(F.lit("Who founded "), "company", F.lit("?")), "founder"),
        (1, F.concat(F.lit("Where is "), "company", F.lit(" headquartered?")), "city"),
        (1, F.concat(F.lit("In what year was "), "company", F.lit(" founded?")), "year"),
        (1, F.concat(F.lit("What is the flagship product of "), "company", F.lit("?")), "product"),
        (2, F.concat(F.lit("Where was the founder of "), "company", F.lit(" born?")), "born"),
        (2, F.concat(F.lit("What is the alma mater of the founder of "), "company", F.lit("?")), "school"),
    ]
    out = None
    for n, (hops, text, want) in enumerate(ask):
        rows = c.where(F.col("i") % every == 0).select((F.col("i") * len(ask) + n).alias("qid"), text.alias("text"), F.col(want).alias("expected"), F.lit(hops).alias("hops"))
        out = rows if out is None else out.union(rows)
    return out
