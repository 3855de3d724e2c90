"""Catalogue listings: normalised rows of raw product data, one listing per code, overlay on candidates, variants and markets, seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as tx
from ..session import growing, written
from .observe import filled, text
from .relational import segments_of

#: Genders of children's sizes and the size category each means (fixed values).
CHILD_SIZES = {"child": "gs", "kids": "gs", "youth": "gs", "preschool": "ps", "toddler": "td", "infant": "td"}
#: Terms that a catalogue is first filled with (fixed values).
SEED_QUERIES = [
    "Nike Air Force 1", "Nike Air Force 1 Low", "Nike Air Force 1 High", "Nike Air Force 1 Shadow", "Air Jordan 1", "Air Jordan 1 Low", "Air Jordan 1 High", "Air Jordan 1 Mid", "Air Jordan 2", "Air Jordan 3",
    "Air Jordan 4", "Air Jordan 5", "Air Jordan 6", "Air Jordan 7", "Air Jordan 9", "Air Jordan 11", "Air Jordan 12", "Air Jordan 13", "Air Jordan 14", "Travis Scott Jordan", "Off-White Jordan", "Union Jordan",
    "Fragment Jordan", "Nike Dunk Low", "Nike Dunk High", "Nike SB Dunk Low", "Nike SB Dunk High", "StrangeLove Dunk", "Off-White Dunk", "Chunky Dunky", "Travis Scott Dunk", "Parra Dunk", "Nike Air Max 1",
    "Nike Air Max 90", "Nike Air Max 95", "Nike Air Max 97", "Nike Air Max 98", "Nike Air Max 270", "Nike Air Max Plus", "Nike Air Max 720", "Nike Cortez", "Nike Blazer Mid", "Nike Blazer Low", "Nike Vapormax",
    "Nike P-6000", "Nike Shox", "Nike Vomero 5", "Nike Kobe", "Nike LeBron", "Adidas Yeezy 350", "Adidas Yeezy 500", "Adidas Yeezy 700", "Adidas Yeezy 380", "Adidas Yeezy 450", "Adidas Yeezy Slide",
    "Adidas Yeezy Foam Runner", "Adidas Samba", "Adidas Gazelle", "Adidas Superstar", "Adidas Stan Smith", "Adidas Campus", "Adidas Ultraboost", "Adidas NMD", "Adidas Forum Low", "Adidas Forum High",
    "Adidas Handball Spezial", "Adidas SL 72", "New Balance 550", "New Balance 574", "New Balance 990", "New Balance 991", "New Balance 992", "New Balance 993", "New Balance 996", "New Balance 997",
    "New Balance 2002R", "New Balance 327", "New Balance 9060", "New Balance 1906R", "New Balance 530", "Asics Gel-Kayano 14", "Asics Gel-1130", "Asics Gel-NYC", "Asics Gel-Lyte III", "Asics Gel-1090",
    "Asics GT-2160", "Converse Chuck 70", "Converse Chuck Taylor", "Vans Old Skool", "Vans Sk8-Hi", "Vans Authentic", "Puma Suede", "Puma RS-X", "Puma Palermo", "Puma Speedcat", "Reebok Classic Leather",
    "Reebok Club C", "Reebok Question", "Salomon XT-6", "Salomon XT-4", "On Cloudmonster", "On Cloud 5", "Hoka Bondi", "Hoka Clifton", "Under Armour Curry", "Crocs Classic Clog", "Timberland 6 Inch Boot", "UGG Tasman",
]
PRODUCT = "productId string, id string, urlKey string, styleId string, title string, brand string, productType string, productAttributes struct<colorway:string,gender:string,releaseDate:string,retailPrice:string>"
VARIANT = "variantId string, variantValue string, variantName string, sizeChart struct<defaultConversion:struct<size:string,type:string>>"
MARKET = "variantId string, variantValue string, lowestAskAmount string, highestBidAmount string, standardMarketData struct<lowestAsk:string,highestBidAmount:string>"


def amount(value: Column) -> Column:
    """A number of a text with commas and dollar signs; null where there is none."""
    return F.trim(F.regexp_replace(value, "[,$]", "")).try_cast("double")


def products(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Columns of a listing from raw JSON, one row each; rows without an identifier or that do not parse are no listings."""
    p = F.from_json(json_col, PRODUCT)
    rows = raw.select(*[c for c in raw.columns if c != json_col], p.alias("p"))
    of = lambda c: text(f"p.{c}")
    return rows.select(
        *[c for c in raw.columns if c != json_col], filled(of("productId"), of("id")).alias("product_id"), of("urlKey").alias("url_key"), of("styleId").alias("style_id"), of("title").alias("title"), of("brand").alias("brand"),
        of("productAttributes.colorway").alias("colorway"), of("productAttributes.gender").alias("gender"), of("productAttributes.releaseDate").alias("release_date"),
        amount(F.col("p.productAttributes.retailPrice")).alias("retail_price"), of("productType").alias("product_type"),
    ).where("product_id <> ''")


def size_of(parsed: Column, gender: Column) -> Column:
    """The title's size category, else what the gender says of it, else empty."""
    chain = F.when(gender.isin("men", "women", "unisex"), F.lit("adult")).otherwise(F.lit(""))
    for name, size in CHILD_SIZES.items():
        chain = F.when(gender == name, F.lit(size)).otherwise(chain)
    return F.when(parsed != "unknown", parsed).otherwise(chain)


def listings(catalog: DataFrame) -> DataFrame:
    """One row per code: the richest of its listings, how many there are and whether any disagrees with the first.

    catalog: product_id, style_id, title, brand, colorway, gender, release_date, retail_price, product_type, ord. A compound style_id
    counts for each of its parts. Titles are parsed once, into a written table; the first listing of a code is found by an aggregate and
    joined back, so no group is held in one place.
    """
    c = F.col
    parsed = models.with_titles(catalog, "title", "brand", "parsed")
    plain = parsed.select(
        F.explode(F.transform(segments_of(c("style_id")), lambda x: x["code"])).alias("style_code"), "product_id", "style_id", text("title").alias("title"),
        filled(c("parsed.brand"), text("brand")).alias("brand"), c("parsed.model").alias("model"), text("colorway").alias("colorway"), F.lower(text("gender")).alias("gender"),
        c("parsed.size_category").alias("said_size"), c("parsed.colorway_text").alias("name_colours"), text("release_date").alias("release_date"), c("retail_price").cast("double").alias("retail_price"), text("product_type").alias("product_type"), "ord",
    )
    plain = tx.with_marks(written(plain, "listing-parts"), {"colour_set": "colorway", "name_set": "name_colours"})
    first = plain.groupBy("style_code").agg(F.min_by(F.struct("title", "model", "colorway", "colour_set", "gender", "said_size"), "ord").alias("first"), F.count(F.lit(1)).alias("n"))
    alone, many = first.where("n = 1"), first.where("n > 1")
    both = growing(plain).join(many, "style_code").withColumns({"first_title": c("first.title"), "first_model": c("first.model")})
    both = models.with_model_similarity(both, "first_title", "title", "alike", names=("first_model", "model"))
    colours = F.when((c("first.colorway") != "") & (c("colorway") != ""), tx.mark_similarity(c("first.colour_set"), c("colour_set")))
    genders = (c("first.gender") != "") & (c("gender") != "") & (c("first.gender") != c("gender"))
    apart = (c("alike") < 0.9) | (colours < 0.9) | (c("first.said_size") != c("said_size")) | genders
    own = ["product_id", "style_id", "title", "brand", "model", "colorway", "gender", "said_size", "name_colours", "colour_set", "name_set", "release_date", "retail_price", "product_type"]
    rich = F.struct((c("colorway") != "").alias("a"), (c("release_date") != "").alias("b"), c("retail_price").isNotNull().alias("c"), F.length("title").alias("d"), (-c("ord")).alias("e"))
    chosen = both.groupBy("style_code").agg(F.max_by(F.struct(*own), rich).alias("x"), F.coalesce(F.bool_or(apart), F.lit(False)).alias("ambiguous"), F.count(F.lit(1)).alias("n_listings"))
    single = plain.join(alone.select("style_code"), "style_code", "left_semi").select("style_code", *own, F.lit(False).alias("ambiguous"), F.lit(1).cast("long").alias("n_listings"))
    every = chosen.select("style_code", "x.*", "ambiguous", "n_listings").unionByName(single)
    return every.withColumns({"size_category": size_of(c("said_size"), c("gender")), "family": tx.known_family(c("brand")), "name_words": tx.name_words(c("name_colours"))}).drop("said_size")


def overlay(candidates: DataFrame, listed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Candidates (query_id, style_code, …) with what the catalogue says of their code, and where it says nothing, the own database;
    name_model and name_colours are what the name says, colour_set and name_set the marks of colourway and name, family that of the
    brand, name_words the words of name_colours.

    known: style_code and any of name, brand, model, colorway, gender, size_category, release_date, retail_price; it only fills gaps.
    """
    c = F.col
    facts = ["name", "brand", "model", "colorway", "gender", "size_category", "release_date"]
    says = listed.select("style_code", "product_id", c("title").alias("name"), "brand", "model", "colorway", "gender", "size_category", "release_date", "retail_price", "product_type", c("ambiguous").alias("disagree"), c("model").alias("name_model"), "name_colours", "colour_set", "name_set", "family", "name_words")
    df = candidates.join(says, "style_code", "left")
    if known is not None:
        own = models.with_titles(known.select("style_code", *[c(f).alias(f"db_{f}") for f in [*facts, "retail_price"]]), "db_name", None, "db_parsed")
        said = c("db_parsed.colorway_text")
        own = own.withColumns({"db_colour_set": tx.marks(tx.colour_tokens(c("db_colorway"))), "db_name_set": tx.marks(tx.colour_tokens(said)), "db_family": tx.known_family(c("db_brand")), "db_name_words": tx.name_words(said)})
        # Written, a row for each code: as a plan it is estimated by the rows it is made of, and candidates would be dealt out by code to meet it.
        own = written(own, "known")
        parsed = lambda f: F.when(text("name") != "", c(f"name_{f}"))
        df = df.join(own, "style_code", "left").withColumns({"name_model": F.coalesce(parsed("model"), c("db_parsed.model")), "name_colours": F.coalesce(parsed("colours"), c("db_parsed.colorway_text"))})
        told = lambda f, other: F.when(text(f) != "", c("colour_set" if f == "colorway" else "name_set")).otherwise(other)
        df = df.withColumns({"colour_set": told("colorway", c("db_colour_set")), "name_set": told("name", c("db_name_set"))})
        df = df.withColumns({"family": F.when(text("brand") != "", c("family")).otherwise(c("db_family")), "name_words": F.when(text("name") != "", c("name_words")).otherwise(c("db_name_words"))})
        df = df.withColumns({**{f: filled(text(f), text(f"db_{f}")) for f in facts}, "retail_price": F.coalesce("retail_price", "db_retail_price")}).drop(*[x for x in df.columns if x.startswith("db_")])
    return df.withColumns({f: text(f) for f in [*facts, "product_type", "name_model", "name_colours"]})


def sizes(variants: DataFrame) -> DataFrame:
    """variant_id, size from raw variants (json): the chart's size, else the variant's value or name; women's US sizes begin with W."""
    v = variants.select(F.from_json("json", VARIANT).alias("v")).where(text("v.variantId") != "")
    size = filled(text("v.sizeChart.defaultConversion.size"), text("v.variantValue"), text("v.variantName"))
    women = (F.lower(text("v.sizeChart.defaultConversion.type")) == "us w") & (size != "") & ~F.upper(size).startswith("W")
    return v.select(F.col("v.variantId").alias("variant_id"), F.when(women, F.concat(F.lit("W"), size)).otherwise(size).alias("size"))


def market(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """product_id, size, lowest_ask, highest_bid of raw market rows (product_id, json) whose ask or bid is known; 0 counts as unknown.

    sized: variant_id, size; a variant it does not name has the row's own value, or ANY.
    """
    m = rows.select("product_id", F.from_json("json", MARKET).alias("m")).where("m IS NOT NULL").withColumn("variant_id", F.col("m.variantId"))
    either = lambda a, b: F.coalesce(F.nullif(amount(F.col(a)), F.lit(0.0)), amount(F.col(b)))
    joined = m.join(sized, "variant_id", "left")
    out = joined.select("product_id", filled(text("size"), text("m.variantValue"), F.lit("ANY")).alias("size"), either("m.lowestAskAmount", "m.standardMarketData.lowestAsk").alias("lowest_ask"), either("m.highestBidAmount", "m.standardMarketData.highestBidAmount").alias("highest_bid"))
    return out.where("lowest_ask IS NOT NULL OR highest_bid IS NOT NULL")


def market_overview(sized_market: DataFrame) -> DataFrame:
    """product_id, lowest_ask, highest_bid, n_sizes."""
    return sized_market.groupBy("product_id").agg(F.min("lowest_ask").alias("lowest_ask"), F.max("highest_bid").alias("highest_bid"), F.count(F.lit(1)).alias("n_sizes"))


def seeds(catalog: DataFrame) -> DataFrame:
    """Updates of the product table from catalogue rows that are sneakers or shoes: keyed by the first code, authoritative where an
    identifier is given."""
    c = F.col
    kind = F.lower(filled(text("product_type"), F.lit("sneakers")))
    rows = models.with_titles(catalog, "title", "brand", "parsed").withColumn("first", F.get(segments_of(c("style_id")), F.lit(0)))
    rows = rows.where(c("first").isNotNull() & (F.contains(kind, F.lit("sneaker")) | F.contains(F.lower(text("product_type")), F.lit("shoe"))))
    return rows.select(
        c("first.code").alias("style_code"), c("first.display").alias("display"), text("title").alias("name"), filled(c("parsed.brand"), text("brand")).alias("brand"), c("parsed.model").alias("model"),
        c("parsed.sub_model").alias("sub_model"), text("colorway").alias("colorway"), F.lower(text("gender")).alias("gender"),
        F.when(c("parsed.size_category") != "unknown", c("parsed.size_category")).otherwise(F.lit("")).alias("size_category"), text("release_date").alias("release_date"),
        "retail_price", "product_id", (text("product_id") != "").alias("authoritative"), "ord",
    )


def reparse(known: DataFrame) -> DataFrame:
    """style_code with new model, sub_model, gender, size_category where a product's name says otherwise than its row (null: unchanged)."""
    c = F.col
    df = models.with_titles(known.where(text("name") != ""), "name", "brand", "p")
    other = lambda f: F.when((c(f"p.{f}") != "") & (c(f"p.{f}") != text(f)), c(f"p.{f}"))
    gap = lambda f: F.when((c(f"p.{f}") != "unknown") & (text(f) == ""), c(f"p.{f}"))
    out = df.select("style_code", other("model").alias("model"), other("sub_model").alias("sub_model"), gap("gender").alias("gender"), gap("size_category").alias("size_category"))
    return out.where("model IS NOT NULL OR sub_model IS NOT NULL OR gender IS NOT NULL OR size_category IS NOT NULL")


def eval_tags(title: Column) -> Column:
    """array<string>: cross_retailer, and gs or womens where the title says so."""
    low = F.lower(F.coalesce(title, F.lit("")))
    has = lambda *ws: F.greatest(*[F.contains(low, F.lit(w)) for w in ws])
    return F.array_compact(F.array(F.lit("cross_retailer"), F.when(has("(gs)", "grade school", "kids"), F.lit("gs")), F.when(has("women", "wmns", "(w)"), F.lit("womens"))))
