"""Observations: everything known of a query, from its page, its title and what its photos show, as columns.

Requests have one row per query: query_id, title, page_brand, price, page_colour, labeled_codes (array of the codes that the page
labels), seen (photos were analysed) and what they showed: v_brand, v_brand_confidence, v_model, v_model_confidence, v_colorway,
v_official (the official colourway's name), v_gender, v_size_category, v_style_code (legible on a tag), v_guesses (array of codes),
v_consistent. Absent texts are empty or null. Titles are parsed once for each distinct one, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, models
from ..functions import text as tx

#: Photos tell brand or model before the title does from this confidence on, and decide alone from the second.
SURE, CERTAIN = 0.5, 0.9


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def filled(*parts: Column) -> Column:
    """The first non-empty text."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))


def known(*parts: Column) -> Column:
    """The first text that is neither empty nor unknown."""
    return F.coalesce(*[F.when(~p.isin("", "unknown"), p) for p in parts], F.lit("unknown"))


def observe(requests: DataFrame) -> DataFrame:
    """query_id with brand and its family, model and its canonical name, colorways and their marks, gender, size_category, price, labeled_codes, tag_code, nickname and its words, collab, colour_named,
    images_consistent; whether size, model and brand come from photos alone, and whether these are certain of model and brand."""
    seen = F.coalesce(F.col("seen"), F.lit(False))
    titled = text("title") != ""
    df = models.with_model(models.with_titles(requests, "title", "page_brand", "parsed"), "v_model", "v_model_name")
    said = lambda field: F.when(titled, F.col(f"parsed.{field}")).otherwise(F.lit(""))
    shown = lambda c: F.when(seen, text(c)).otherwise(F.lit(""))
    sure = lambda c, least: seen & (F.coalesce(F.col(c), F.lit(0.0)) >= least)
    best = lambda field, c: F.when((shown(c) != "") & sure(f"{c}_confidence", SURE), shown(c)).otherwise(filled(said(field), shown(c)))
    alone = lambda field: seen & said(field).isin("", "unknown")
    # Colours as they are told, in order, each with its marks.
    df = df.withColumns({"colour_0": shown("v_colorway"), "colour_1": shown("v_official"), "colour_2": text("page_colour"), "colour_3": said("colorway_text")})
    df = tx.with_marks(df, {f"marks_{i}": f"colour_{i}" for i in range(4)})
    colours = F.filter(F.array(*[F.struct(F.col(f"colour_{i}").alias("text"), F.col(f"marks_{i}").alias("marks")) for i in range(4)]), lambda x: x["text"] != "")
    model = best("model", "v_model")
    return df.select(
        "query_id",
        best("brand", "v_brand").alias("brand"),
        tx.known_family(best("brand", "v_brand")).alias("family"),
        model.alias("model"),
        # A title's model is a canonical name already.
        F.when(model == said("model"), F.when(~model.isin(models.NUMBERED), model).otherwise(F.lit(""))).otherwise(F.col("v_model_name")).alias("model_name"),
        F.transform(colours, lambda x: x["text"]).alias("colorways"),
        F.transform(colours, lambda x: x["marks"]).alias("colour_sets"),
        known(said("gender"), shown("v_gender")).alias("gender"),
        known(said("size_category"), shown("v_size_category")).alias("size_category"),
        F.col("price").cast("double").alias("price"),
        F.coalesce("labeled_codes", F.array().cast("array<string>")).alias("labeled_codes"),
        codes.normalize_code(shown("v_style_code")).alias("tag_code"),
        F.lower(F.trim(shown("v_official"))).alias("nickname"),
        tx.name_words(F.lower(F.trim(shown("v_official")))).alias("nickname_words"),
        said("collab").alias("collab"),
        (~seen | F.coalesce(F.col("v_consistent"), F.lit(True))).alias("images_consistent"),
        alone("size_category").alias("size_from_photos"),
        alone("model").alias("model_from_photos"),
        alone("brand").alias("brand_from_photos"),
        sure("v_model_confidence", CERTAIN).alias("model_certain"),
        sure("v_brand_confidence", CERTAIN).alias("brand_certain"),
    )


EVIDENCE = ["query_id", "style_code", "display", "kind", "detail", "weight", "similarity", "ord"]


def evidence_of_photos(requests: DataFrame, first_ord: int = 1000) -> DataFrame:
    """EVIDENCE rows of what photos show: a code legible on a tag (0.9) and up to three codes that are guessed (0.35)."""
    hint = codes.family_of(F.concat_ws(" ", text("v_brand"), text("v_model")))
    read = F.struct(F.lit("vision_tag").alias("kind"), F.lit("read on a tag or box").alias("detail"), F.lit(0.9).alias("weight"), F.col("v_style_code").alias("code"))
    guess = lambda c: F.struct(F.lit("vision_guess").alias("kind"), F.lit("recalled from photos").alias("detail"), F.lit(0.35).alias("weight"), c.alias("code"))
    guesses = F.transform(F.slice(F.coalesce("v_guesses", F.array().cast("array<string>")), 1, 3), guess)
    named = lambda h: F.transform(F.concat(F.array(read), guesses), lambda x, i: F.struct(i.alias("i"), x.alias("x"), codes.identifier_code(x["code"], h).alias("code")))
    rows = requests.where("seen").select("query_id", F.explode(F.filter(tx.let(hint, named), lambda r: r["code"].isNotNull())).alias("r")).select("query_id", "r.*")
    return rows.select("query_id", F.col("code.code").alias("style_code"), F.col("code.display").alias("display"), "x.kind", "x.detail", "x.weight", F.lit(None).cast("double").alias("similarity"), (F.col("i") + first_ord).cast("long").alias("ord"))


def evidence_of_pages(page_codes: DataFrame, first_ord: int = 0) -> DataFrame:
    """EVIDENCE rows of codes found on pages (query_id, code, display, source, confidence, ord)."""
    return page_codes.select("query_id", F.col("code").alias("style_code"), "display", F.lit("page_sku").alias("kind"), F.col("source").alias("detail"), F.col("confidence").alias("weight"), F.lit(None).cast("double").alias("similarity"), (F.col("ord") + first_ord).cast("long").alias("ord"))


def evidence_of_neighbours(near: DataFrame, floor: float, first_ord: int = 2000) -> DataFrame:
    """EVIDENCE rows of visual neighbours (query_id, style_code, display, similarity, ord) at the similarity floor or above.

    Photos from the web may be given in the same form: one below the floor says nothing and never votes against a candidate.
    """
    rows = near.where(F.col("similarity") >= floor)
    return rows.select("query_id", codes.normalize_code(F.col("style_code")).alias("style_code"), "display", F.lit("embedding").alias("kind"), F.concat(F.lit("cosine "), F.format_number("similarity", 3)).alias("detail"), F.col("similarity").alias("weight"), "similarity", (F.col("ord") + first_ord).cast("long").alias("ord"))


def evidence_of_web(web: DataFrame, most: int = 12, first_ord: int = 3000) -> DataFrame:
    """EVIDENCE rows of the codes that web pages agree on most (query_id, style_code, display, domains, trust, agreement, first_ord)."""
    from .merge import top_n

    best = top_n(web, ["query_id"], most, F.desc("trust"), F.desc("agreement"), F.col("first_ord"))
    return best.select("query_id", "style_code", "display", F.lit("web").alias("kind"), F.array_join(F.slice("domains", 1, 4), ",").alias("detail"), F.least(F.lit(1.0), F.col("trust") / 2).alias("weight"), F.lit(None).cast("double").alias("similarity"), (F.col("rank") + first_ord).cast("long").alias("ord"))


def evidence_of_catalog(hits: DataFrame, most: int = 20, first_ord: int = 4000) -> DataFrame:
    """EVIDENCE rows of catalogue text hits (query_id, product_id, style_id, ord): one for each part of a compound code."""
    from .merge import arg_first, top_n
    from .relational import segments_of

    once = top_n(arg_first(hits.select("query_id", "product_id", "style_id", "ord"), ["query_id", "product_id"], ["ord"]), ["query_id"], most, F.col("ord"))
    parts = once.select("query_id", "rank", F.posexplode(segments_of(F.col("style_id"))).alias("i", "part"))
    return parts.select("query_id", F.col("part.code").alias("style_code"), F.col("part.display").alias("display"), F.lit("catalog_search").alias("kind"), F.lit("catalog text search").alias("detail"), F.lit(0.2).alias("weight"), F.lit(None).cast("double").alias("similarity"), (F.col("rank") * 100 + F.col("i") + first_ord).cast("long").alias("ord"))


#: A row of gathered() without its query.
GATHERED = "struct<style_code: string, edges: array<struct<ord: bigint, kind: string, detail: string, weight: double>>, shown: struct<ord: bigint, display: string>, similarity: double, ord: bigint>"


def gathered(evidence: DataFrame) -> DataFrame:
    """One row per query and code from EVIDENCE rows: edges (struct ord, kind, detail, weight; distinct by kind and detail, in order),
    shown (struct ord, display of the first row that has one), similarity (the best) and ord (of the first row).

    Two aggregates with partial sums: the first row of each (kind, detail), then one row per candidate.
    """
    shown = F.when((text("display") != "") & (codes.normalize_code(F.col("display")) != F.col("display")), F.struct("ord", "display"))
    rows = evidence.where(text("style_code") != "").withColumn("shown", shown)
    edges = rows.groupBy("query_id", "style_code", "kind", "detail").agg(F.min_by("weight", "ord").alias("weight"), F.min("ord").alias("ord"), F.max("similarity").alias("similarity"), F.min("shown").alias("shown"))
    own = F.array_sort(F.collect_list(F.struct("ord", "kind", "detail", "weight")))
    return edges.groupBy("query_id", "style_code").agg(own.alias("edges"), F.min("shown").alias("shown"), F.max("similarity").alias("similarity"), F.min("ord").alias("ord"))


def told(edges: Column) -> Column:
    return F.transform(edges, lambda e: F.struct(e["kind"].alias("kind"), e["detail"].alias("detail"), e["weight"].alias("weight")))


def candidate(x: Column) -> Column:
    """struct(style_code, display, evidence, similarity, ord) of a struct GATHERED."""
    return F.struct(
        x["style_code"].alias("style_code"), F.coalesce(x["shown"]["display"], x["style_code"]).alias("display"), told(x["edges"]).alias("evidence"), x["similarity"].alias("similarity"), x["ord"].alias("ord")
    )


def by_query(rows: DataFrame, name: str) -> DataFrame:
    """One row per query with its rows of gathered() as an array: what one request has found, no more."""
    row = F.struct("style_code", "edges", "shown", "similarity", "ord").cast(GATHERED)
    return rows.select("query_id", row.alias("row")).groupBy("query_id").agg(F.collect_list("row").alias(name))


def ready(df: DataFrame, name: str) -> DataFrame:
    """df of by_query() with its rows as the candidates that they are by themselves, for a side that many queries meet."""
    return df.withColumn(f"{name}_ready", F.transform(name, candidate))


def met(df: DataFrame, a: str, b: str) -> DataFrame:
    """Candidates, as of pool(), of queries with the columns of two by_query(): a code that both have is one candidate with the evidence of both."""
    return met_by_query(df, a, b).select("query_id", F.explode("candidates").alias("c")).select("query_id", "c.*")


def met_by_query(df: DataFrame, a: str, b: str) -> DataFrame:
    """query_id, candidates: those of met() as an array, one row a query; b may be ready()."""
    df = df if f"{b}_ready" in df.columns else ready(df, b)
    here, there = F.col(f"{a}.style_code"), F.col(f"{b}.style_code")

    def both(x: Column, y: Column) -> Column:
        # least, greatest and array_min pass nulls over.
        return candidate(
            F.struct(
                x["style_code"].alias("style_code"), F.array_sort(F.concat(x["edges"], y["edges"])).alias("edges"), F.array_min(F.array(x["shown"], y["shown"])).alias("shown"),
                F.greatest(x["similarity"], y["similarity"]).alias("similarity"), F.least(x["ord"], y["ord"]).alias("ord"),
            )
        )

    # A query may have either alone.
    same = F.arrays_overlap(here, there)
    alone = F.filter(f"{b}_ready", lambda y: ~F.array_contains(here, y["style_code"]))
    own = F.transform(a, lambda x: F.when(F.array_contains(there, x["style_code"]), both(x, F.get(b, (F.array_position(there, x["style_code"]) - 1).cast("int")))).otherwise(candidate(x)))
    single = F.transform(a, candidate)
    every = F.when(same, F.concat(own, alone)).when(here.isNull(), F.col(f"{b}_ready")).when(there.isNull(), single).otherwise(F.concat(single, f"{b}_ready"))
    return df.select("query_id", every.alias("candidates"))


def pool(evidence: DataFrame) -> DataFrame:
    """One candidate per query and code from EVIDENCE rows of all sources: display, evidence (struct kind, detail, weight; distinct
    by kind and detail, in order), similarity (the best) and ord (of the first row)."""
    return gathered(evidence).select("query_id", "style_code", F.coalesce("shown.display", "style_code").alias("display"), told(F.col("edges")).alias("evidence"), "similarity", "ord")
