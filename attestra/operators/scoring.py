"""Scoring and resolution of candidates as columns: components, contradictions, verdicts, tiers, winners, final rows.

Pairs are candidates beside their query's observation (columns o_*, from `pair`). Every step adds columns; `resolve` and `finalize`
rank by one window per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import models
from ..functions import text as tx
from ..session import growing
from .observe import filled, text

NEUTRAL = 0.5
#: Words of a product type that is footwear (fixed values).
FOOTWEAR = "sneaker|shoe|footwear|boot|slide|sandal|clog"
#: Evidence that counts as a signal of its own (fixed values).
SIGNALS = ("page_sku", "vision_tag", "web", "embedding", "vision_guess", "user")
#: Colours of an observation, at most.
COLOURS = 4
COMPONENTS = ("sku", "model", "colorway", "embedding", "metadata", "agreement")


def round4(x: Column) -> Column:
    """Four decimals, halves up, by one rule of double arithmetic that other engines share to the bit."""
    return F.floor(x * 10000 + 0.5) / 10000.0


def rescale(similarity: Column, floor: float, full: float) -> Column:
    """Cosine to [0, 1] between floor and full; unknown is 0.5."""
    scaled = (similarity - floor) / max(1e-6, full - floor)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)), F.lit(NEUTRAL))


def pair(candidates: DataFrame, observations: DataFrame, web: DataFrame) -> DataFrame:
    """Candidates with their observation as o_* and what the web says of their code (query_id, style_code, agreement, trust)."""
    return with_web(candidates.join(growing(told_by_query(observations, web)), "query_id"))


def pair_by_query(found: DataFrame, observations: DataFrame, web: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """pair() of candidates that are an array (query_id, candidates): queries meet their observation, a row each, before candidates become rows.

    verdicts, as of verify(), come along as an array of those of the query, which verify() takes up.
    """
    told = told_by_query(observations, web)
    if verdicts is not None:
        told = told.join(growing(verdicts_of(verdicts).groupBy("query_id").agg(F.collect_list(F.struct("style_code", *VERDICT)).alias(TOLD))), "query_id", "left")
    both = found.join(growing(told), "query_id").withColumn("c", F.explode("candidates"))
    return with_web(both.select("query_id", "c.*", *[c for c in both.columns if c not in ("query_id", "candidates", "c")]))


def told_by_query(observations: DataFrame, web: DataFrame) -> DataFrame:
    """Observations as o_* with said, what the web says of the query's codes, one row a query."""
    own = observations.select("query_id", *[F.col(c).alias(f"o_{c}") for c in observations.columns if c != "query_id"])
    # It comes along with the observation, so that candidates are dealt once.
    said = web.groupBy("query_id").agg(F.collect_list(F.struct("style_code", F.col("agreement").alias("web_agreement"), F.col("trust").alias("web_trust"))).alias("said"))
    return own.join(growing(said), "query_id", "left")


def with_web(both: DataFrame) -> DataFrame:
    """Candidates with what is said of their own code."""
    told = F.filter("said", lambda w: w["style_code"] == F.col("style_code"))
    return both.withColumn("w", F.explode_outer(told)).select(*[F.col(c) for c in both.columns if c != "said"], "w.web_agreement", "w.web_trust")


def sku_component(evidence: Column, agreement: Column, trust: Column) -> Column:
    """struct(value, why): the best of the evidence (struct kind, weight); web evidence without a web row counts one domain of trust 0.5."""
    kind, weight = (lambda e: e["kind"]), (lambda e: e["weight"])
    web = F.least(F.lit(1.0), 0.35 + 0.15 * F.coalesce(agreement, F.lit(1)) + 0.1 * F.least(F.coalesce(trust, F.lit(0.5)), F.lit(2.0)))
    value = lambda e: (
        F.when(kind(e) == "page_sku", F.when(weight(e) >= 0.85, F.lit(1.0)).otherwise(F.lit(0.8)))
        .when(kind(e) == "vision_tag", F.lit(0.9))
        .when(kind(e) == "web", web)
        .when(kind(e) == "vision_guess", F.lit(0.35))
        .when(kind(e) == "catalog_search", F.lit(0.15))
        .when(kind(e) == "embedding", F.lit(0.1))
        .otherwise(F.lit(0.0))
    )
    scored = F.transform(evidence, lambda e, i: F.struct(value(e).alias("value"), (-i).alias("order"), kind(e).alias("why")))
    told = lambda v, why: F.when(v > 0, F.struct(v.alias("value"), why.alias("why")))
    # Most candidates have one row of evidence, which needs no comparison.
    only = F.get(evidence, F.lit(0))
    best = F.when(F.size(evidence) == 1, told(value(only), kind(only))).otherwise(tx.let(F.array_max(scored), lambda b: told(b["value"], b["why"])))
    return F.coalesce(best, F.struct(F.lit(0.0).alias("value"), F.lit("none").alias("why")))


def mean_of_known(*checks: Column) -> Column:
    """Mean of the checks that are not null; 0.5 where none is."""
    total = sum((F.coalesce(x, F.lit(0.0)) for x in checks), F.lit(0.0))
    return F.coalesce(F.try_divide(total, sum((x.isNotNull().cast("int") for x in checks), F.lit(0))), F.lit(NEUTRAL))


def same_family(x: Column, y: Column) -> Column:
    """Whether two families of brands are one; null where either is not known."""
    return F.when((x != "") & (y != ""), x == y)


def colour_component(wanted: Column, colorway: Column, colours: Column, name: Column, name_words: Column, name_colours: Column, nickname: Column, nickname_words: Column) -> Column:
    """The best likeness of the observed colours (an array of marks) with the catalogue's, else with the name's; or by the nickname."""
    target = F.when(text(colorway) != "", colours).when(text(name) != "", name_colours)
    # An observation has four colours at most: what photos, their official name, the page and the title say.
    by_colour = F.greatest(*[tx.mark_similarity(F.get(wanted, F.lit(i)), target) for i in range(COLOURS)])
    by_name = F.when((nickname != "") & (text(name) != ""), tx.words_score(nickname_words, name_words))
    return F.coalesce(F.greatest(by_colour, by_name), F.lit(NEUTRAL))


def metadata_component(price: Column, retail: Column, *checks: Column) -> Column:
    """Mean of a price ratio in [0.55, 1.35] and of the tri-state checks, as far as they are known."""
    priced = (F.coalesce(price, F.lit(0.0)) != 0) & (F.coalesce(retail, F.lit(0.0)) != 0)
    ratio = F.try_divide(price, retail)
    flag = lambda same: F.when(same, F.lit(1.0)).when(~same, F.lit(0.0))
    return mean_of_known(F.when(priced, F.when((ratio >= 0.55) & (ratio <= 1.35), F.lit(1.0)).otherwise(F.lit(0.3))), *map(flag, checks))


def score(pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Pairs with the components c_*, why (the evidence that gave c_sku), raw_score, and what contradictions need besides.

    Candidates have query_id, style_code, evidence (array of struct kind, weight), similarity, ord and, empty where nothing is known,
    name, brand, model, colorway, gender, size_category, retail_price, product_type, disagree (several listings that differ), and what
    the name says: name_model, name_colours and its words name_words, the brand's family, and the marks of colourway and name: colour_set, name_set. Models of candidates are canonical names, as titles are parsed to.
    """
    s = settings or Settings()
    t, c = s.thresholds, F.col
    df = pairs.withColumn("own_model", filled(text("model"), text("name_model")))
    df = df.withColumns({"same_size": tx.compatible(c("o_size_category"), c("size_category")), "same_gender": tx.compatible(c("o_gender"), c("gender"), "unisex"), "same_brand": same_family(c("o_family"), c("family"))})
    df = models.with_model_similarity(df, "o_model", "own_model", "model_similarity", names=("o_model_name", "own_model"))
    strong = F.array_intersect(c("evidence.kind"), F.array(*map(F.lit, SIGNALS)))
    df = df.withColumn("sku", sku_component(c("evidence"), c("web_agreement"), c("web_trust"))).withColumns(
        {
            "c_sku": c("sku.value"),
            "why": c("sku.why"),
            "c_model": F.coalesce(c("model_similarity"), F.lit(NEUTRAL)),
            "c_colorway": colour_component(c("o_colour_sets"), c("colorway"), c("colour_set"), c("name"), c("name_words"), c("name_set"), c("o_nickname"), c("o_nickname_words")),
            "c_embedding": rescale(c("similarity"), t.similarity_floor, t.similarity_full),
            "c_metadata": metadata_component(c("o_price"), c("retail_price"), c("same_gender"), c("same_size"), c("same_brand")),
            "c_agreement": F.least(F.lit(1.0), F.size(strong) / 2.0),
        }
    )
    total = sum((c(f"c_{n}") * getattr(s.weights, n) for n in COMPONENTS), F.lit(0.0))
    return df.withColumn("raw_score", round4(total)).drop("sku")


def contradict(scored: DataFrame) -> DataFrame:
    """Adds contradictions (hard ones first), penalty, rejected, rejection_reason and the score after the penalty.

    What is known of the query from photos alone weighs against a candidate, and rejects it only where the photos are certain.
    """
    c = F.col
    kind = F.lower(text("product_type"))
    asked, own, sim = c("o_model_name"), c("own_model"), c("model_similarity")
    apart = (asked != "") & (own != "") & (asked != own)
    other = apart & (sim < 0.5)
    unsure = lambda what: c(f"o_{what}_from_photos") & ~c(f"o_{what}_certain")
    hard = [
        ((kind != "") & ~kind.rlike(FOOTWEAR), "product_type"),
        (~c("same_size") & ~c("o_size_from_photos"), "size_category_mismatch"),
        (other & ~unsure("model"), "model_mismatch"),
        (~c("same_brand") & ~unsure("brand"), "brand_mismatch"),
    ]
    soft = [
        (~c("same_size") & c("o_size_from_photos"), 0.25, "size_category_mismatch_in_photos"),
        (~c("same_gender"), 0.15, "gender_mismatch"),
        (other & unsure("model"), 0.3, "model_mismatch_in_photos"),
        (apart & (sim >= 0.5) & (sim < 0.9), 0.05, "model_height_unspecified"),
        ((F.round("c_colorway", 4) < 0.2) & (F.size("o_colorways") > 0) & (text("colorway") != ""), 0.3, "colorway_conflict"),
        ((c("o_tag_code") != "") & (c("o_tag_code") != c("style_code")), 0.4, "tag_style_code_mismatch"),
        ((F.size("o_labeled_codes") > 0) & ~F.array_contains("o_labeled_codes", c("style_code")), 0.25, "page_style_code_mismatch"),
        (~c("same_brand") & unsure("brand"), 0.3, "brand_mismatch_in_photos"),
        ((text("o_collab") != "") & (text("name") != "") & ~F.contains(F.lower("name"), F.lower(text("o_collab"))), 0.2, "collab_missing"),
        (~c("o_images_consistent"), 0.1, "query_images_inconsistent"),
        ((text("name") == "") & (text("model") == "") & (text("colorway") == ""), 0.3, "no_catalog_identity"),
    ]
    many = F.coalesce(c("disagree"), F.lit(False))
    fired = lambda cond: F.coalesce(cond, F.lit(False))
    penalty = sum((F.when(fired(cond), F.lit(p)).otherwise(F.lit(0.0)) for cond, p, _ in soft), F.lit(0.0)) + F.when(many, F.lit(0.05)).otherwise(F.lit(0.0))
    names = lambda rules: F.array_compact(F.array(*[F.when(fired(r[0]), F.lit(r[-1])) for r in rules]))
    df = scored.withColumns({"hard": names(hard), "soft": names([(many, "several_products"), *soft]), "penalty": penalty})
    return df.withColumns(
        {
            "contradictions": F.concat("hard", "soft"),
            "rejected": F.size("hard") > 0,
            "rejection_reason": F.coalesce(F.get("hard", F.lit(0)), F.lit("")),
            "score": round4(F.greatest(F.lit(0.0), c("raw_score") - c("penalty"))),
        }
    ).drop("hard", "soft")


#: What is known of a verdict, and the column in which a query's verdicts come along with its candidates.
VERDICT, TOLD = ("verdict", "verdict_confidence", "notes"), "told_verdicts"


def verdicts_of(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("query_id", "style_code", F.lower(F.trim("verdict")).alias("verdict"), F.col("confidence").alias("verdict_confidence"), F.col("contradictions").alias("notes"))


def verify(df: DataFrame, verdicts: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """Verdicts (query_id, style_code, verdict, confidence, contradictions) joined by code: different rejects and adds its notes,
    uncertain caps the score below medium, same lifts it with its confidence.

    Without verdicts, those that came along by pair_by_query(): candidates, wide rows by now, stay where their query is.
    """
    t, c = (settings or Settings()).thresholds, F.col
    if verdicts is None:
        own = df.withColumn("v", F.explode_outer(F.filter(TOLD, lambda v: v["style_code"] == c("style_code"))))
        joined = own.select("query_id", "style_code", *[c(x) for x in df.columns if x not in ("query_id", "style_code", TOLD)], *[f"v.{x}" for x in VERDICT])
    else:
        joined = df.join(growing(verdicts_of(verdicts)), ["query_id", "style_code"], "left")
    lift = F.when(c("verdict_confidence") >= 0.85, F.lit(0.10)).when(c("verdict_confidence") >= 0.7, F.lit(0.05)).otherwise(F.lit(0.0))
    changed = F.when(c("verdict") == "same", round4(F.least(F.lit(1.0), c("score") + lift))).when(c("verdict") == "uncertain", round4(F.least(c("score"), F.lit(t.medium - 0.01))))
    different = F.coalesce(c("verdict") == "different", F.lit(False))
    notes = F.when(different, F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.concat(F.lit("verifier:"), n))).otherwise(F.array().cast("array<string>"))
    return joined.withColumns(
        {
            "score": F.coalesce(changed, c("score")),
            "rejected": c("rejected") | different,
            "rejection_reason": F.when((c("rejection_reason") == "") & different, F.lit("verifier:different")).otherwise(c("rejection_reason")),
            "contradictions": F.concat("contradictions", notes),
        }
    ).drop("notes")


def tier(confidence: Column, settings: Settings | None = None) -> Column:
    t = (settings or Settings()).thresholds
    return F.when(confidence >= t.high, F.lit("high")).when(confidence >= t.medium, F.lit("medium")).when(confidence >= t.low, F.lit("low")).otherwise(F.lit("unresolved"))


#: What puts candidates in order and tells the runner-up, what resolve() asks of the winner besides, what finalize() shows of it, and what both need of the observation.
TURN = ("dead", "back", "ord", "rejected", "style_code", "verdict")
WINNER = ("verdict_confidence", "clean", "doubted", "c_model", "c_colorway")
SHOWN = ("style_code", "display", "name", "brand", "model", "colorway")
ASKED = ("o_brand", "o_model", "o_model_name", "o_colorways")
#: Candidates of a final row, at most.
MOST = 12


def standings(candidates: DataFrame, most: int = MOST, every: bool = False) -> DataFrame:
    """One row a query of its candidates: what resolve() and finalize() need of them, so that candidates themselves need not be kept or dealt out.

    leader: the first living one by score, then as they came. candidates: the codes of the best `most` in that order, the rejected last. top: the
    first, where those without any identity come behind those with one; next_*: the one behind it. own: SHOWN of every row of the code of top, or of all
    rows if every is set; and ASKED of the observation. Columns that candidates do not have are left out. A query's candidates meet as an array, which
    holds what one request has found: TURN of each; the rest is kept of the first alone, before rows are dealt out.
    """
    c = F.col
    there = lambda names: [n for n in names if n in candidates.columns]
    known = (text("name") != "") | (text("colorway") != "") | (text("model") != "")
    rows = candidates.withColumns(
        {
            "dead": F.when(c("rejected"), F.lit(2)).when(~known, F.lit(1)).otherwise(F.lit(0)), "back": -c("score"),
            "clean": F.size("contradictions") == 0, "doubted": F.exists("contradictions", lambda x: x.startswith("verifier:")),
        }
    )
    # Structs are compared field by field: what comes first in TURN is first among rows as well.
    shown = F.struct(*there(SHOWN))
    kept = [F.collect_list(F.struct(*TURN)).alias("rows"), F.min(F.struct(*TURN, *WINNER, shown.alias("shown"))).alias("top"), *([F.collect_list(shown).alias("all")] if every else [])]
    rows = rows.groupBy("query_id").agg(*kept, *[F.first(n).alias(n) for n in there(ASKED)])
    rows = rows.withColumns({"turns": F.sort_array("rows"), "places": F.sort_array(F.transform("rows", lambda x: F.struct(x["rejected"], x["back"], x["ord"], x["style_code"].alias("style_code"))))})
    first, second = F.get("places", F.lit(0)), F.get("turns", F.lit(1))
    # Rows of one code differ in what web and verdicts say alone.
    same = F.size(F.filter("rows", lambda x: x["style_code"] == c("top.style_code")))
    return rows.select(
        "query_id", F.when(~first["rejected"], first["style_code"]).alias("leader"), F.struct("top.style_code", (-c("top.back")).alias("score"), "top.dead", "top.verdict", *[f"top.{n}" for n in WINNER]).alias("top"),
        second["dead"].alias("next_dead"), (-second["back"]).alias("next_score"), second["verdict"].alias("next_verdict"),
        F.slice(F.transform("places", lambda x: x["style_code"]), 1, most).alias("candidates"), c("all").alias("own") if every else F.array_repeat("top.shown", same).alias("own"), *there(ASKED),
    )


def resolve(queries: DataFrame, candidates: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per query: style_code, confidence, status, failure and the notes that explain them.

    queries: query_id, confirmed (the catalogue confirms the leader), labeled_codes. candidates: rows of verify(), or their standings().
    Living candidates with an identity come first; the winner and its runner-up decide.
    """
    t, c = (settings or Settings()).thresholds, F.col
    stood = candidates if "top" in candidates.columns else standings(candidates)
    top = stood.select("query_id", "top.*", "next_dead", "next_score", "next_verdict")
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    row = queries.select("query_id", "confirmed", "labeled_codes").join(growing(top), "query_id", "left")
    same, unsure = yes(c("verdict") == "same"), yes(c("verdict") == "uncertain")
    gone, unnamed = c("dead").isNull() | (c("dead") == 2), yes(c("dead") == 1)
    close = yes((c("next_dead") == 0) & (c("next_score") >= c("score") - t.runner_up_gap)) & ~(same & ~yes(c("next_verdict") == "same"))
    agreed = same & yes(c("verdict_confidence") >= 0.7)
    printed = (
        yes(F.array_contains("labeled_codes", c("style_code"))) & yes(c("confirmed")) & yes(c("clean"))
        & yes(F.round("c_model", 4) >= NEUTRAL) & (yes(F.round("c_colorway", 4) >= NEUTRAL) | agreed) & ~close & ~unsure
    )
    row = row.withColumns({"gone": gone, "unnamed": unnamed, "close": close, "printed": printed, "same": same, "doubted": yes(c("doubted"))})
    base = F.when(c("close"), F.least(c("score"), F.lit(t.medium - 0.01))).otherwise(c("score"))
    lifted = F.when(c("printed"), F.greatest(base, F.lit(t.high))).otherwise(base)
    capped = F.when((lifted >= t.high) & ~c("same") & ~c("printed"), F.lit(t.high - 0.01)).otherwise(lifted)
    low = c("doubted") & (capped >= t.medium)
    confidence = F.when(c("gone"), F.lit(0.0)).when(c("unnamed"), F.least(c("score"), F.lit(t.low - 0.01))).when(low, F.least(capped, F.lit(t.medium - 0.01))).otherwise(capped)
    failure = F.when(c("dead").isNull(), F.lit("NO_CANDIDATES")).when(c("gone"), F.lit("CONTRADICTORY_EVIDENCE")).when(c("unnamed"), F.lit("CATALOG_MATCH_UNCERTAIN")).when(c("close"), F.lit("MULTIPLE_CANDIDATES")).otherwise(F.lit(""))
    status = F.when(c("gone") | c("unnamed"), F.lit("unresolved")).when(low, F.lit("low")).otherwise(tier(capped, settings))
    return row.select(
        "query_id", F.when(~c("gone"), c("style_code")).alias("style_code"), round4(confidence).alias("confidence"), status.alias("status"), failure.alias("failure"),
        c("printed").alias("page_confirmed"), c("close").alias("ambiguous"),
    )


def finalize(resolved: DataFrame, candidates: DataFrame, failures: DataFrame, catalog: DataFrame, most: int = MOST, settings: Settings | None = None) -> DataFrame:
    """One row per query with the final status, the canonical product, the catalogue's match and its market, and the best candidates.

    candidates: rows of verify(), or their standings(). failures: query_id, codes (array of failure codes of earlier steps). catalog: query_id, product_id, title, confirmed, lowest_ask,
    highest_bid of the winner's listing. A contradiction noted earlier demotes high to medium and leaves the confidence; market data
    are withheld from unresolved queries; an unconfirmed listing's match stays below medium.
    """
    t, c = (settings or Settings()).thresholds, F.col
    stood = candidates if "top" in candidates.columns else standings(candidates, most, every=True)
    stood = stood.select("query_id", F.slice("candidates", 1, most).alias("candidates"), "own", "o_brand", "o_model", "o_colorways")
    df = resolved.join(growing(stood), "query_id", "left").join(growing(failures), "query_id", "left").join(growing(catalog.withColumnRenamed("confirmed", "listed")), "query_id", "left")
    df = df.withColumn("x", F.explode_outer(F.filter("own", lambda x: x["style_code"] == c("style_code")))).select(*[c(n) for n in df.columns if n != "own"], *[f"x.{n}" for n in SHOWN if n != "style_code"])
    every = F.array_distinct(F.filter(F.concat(F.coalesce("codes", F.array().cast("array<string>")), F.array("failure")), lambda x: x != ""))
    demoted = F.array_contains(every, "CONTRADICTORY_EVIDENCE") & (c("status") == "high")
    df = df.withColumns({"failures": every, "status": F.when(demoted, F.lit("medium")).otherwise(c("status"))})
    withheld = c("style_code").isNull() | (c("status") == "unresolved")
    market = lambda x: F.when(~withheld, c(x)).alias(x)
    match = F.when(F.coalesce("listed", F.lit(False)), c("confidence")).otherwise(round4(F.least(c("confidence"), F.lit(t.medium - 0.01))))
    return df.select(
        "query_id", "status", c("status").isin("high", "medium").alias("identified"), "confidence", F.array_join("failures", ",").alias("failures"),
        (c("status").isin("low", "unresolved") | F.arrays_overlap("failures", F.array(F.lit("MULTIPLE_CANDIDATES"), F.lit("CATALOG_MATCH_UNCERTAIN")))).alias("review_required"),
        F.when(c("style_code").isNotNull(), filled(text("display"), text("style_code"))).alias("style_code"),
        F.when(c("style_code").isNotNull(), filled(text("brand"), text("o_brand"))).alias("brand"),
        F.when(c("style_code").isNotNull(), filled(text("model"), text("o_model"))).alias("model"),
        F.when(c("style_code").isNotNull(), filled(text("colorway"), text(F.get("o_colorways", F.lit(0))))).alias("colorway"),
        F.when(c("style_code").isNotNull(), text("name")).alias("product_name"),
        F.when(c("style_code").isNotNull(), c("product_id")).alias("product_id"),
        F.when(c("style_code").isNotNull() & c("product_id").isNotNull(), match).alias("match_confidence"),
        market("lowest_ask"), market("highest_bid"), F.array_join("candidates", ",").alias("candidates"),
    )


def confirm(leaders: DataFrame, listings: DataFrame) -> DataFrame:
    """query_id, product_id, title, ambiguous, confirmed: the catalogue's listing of each query's leader.

    leaders: query_id, style_code, o_model, o_model_name. listings: style_code, product_id, title, model (its canonical name),
    ambiguous, one row per code. A listing confirms unless listings of the code disagree or its model is another one (similarity
    below 0.6).
    """
    df = models.with_model_similarity(growing(leaders).join(listings, "style_code"), "o_model", "title", "agree", names=("o_model_name", "model"))
    alike = (text("o_model") == "") | F.col("agree").isNull() | (F.col("agree") >= 0.6)
    return df.select("query_id", "product_id", "title", "ambiguous", (~F.col("ambiguous") & alike).alias("confirmed"))


def override(resolved: DataFrame, decisions: DataFrame) -> DataFrame:
    """resolved (query_id, style_code, confidence, status, review_required) after the latest human decision of each query.

    decisions: query_id, action (confirm, select, manual_sku, reject), chosen, decided_at, ord. A match is high and certain, a rejection
    has no product; a select or manual_sku without a recognisable code is no decision.
    """
    c = F.col
    valid = decisions.where(c("action").isin("confirm", "reject") | (c("action").isin("select", "manual_sku") & (text("chosen") != "")))
    last = valid.groupBy("query_id").agg(F.max_by(F.struct("action", "chosen"), F.struct("decided_at", "ord")).alias("d")).select("query_id", "d.action", "d.chosen")
    df = resolved.join(growing(last), "query_id", "left")
    chosen = F.when(c("action") == "confirm", c("style_code")).otherwise(c("chosen"))
    decided, out = c("action").isNotNull(), c("action") == "reject"
    return df.select(
        "query_id",
        F.when(out, F.lit(None).cast("string")).when(decided, chosen).otherwise(c("style_code")).alias("style_code"),
        F.when(decided & ~out, F.lit(1.0)).otherwise(c("confidence")).alias("confidence"),
        F.when(out, F.lit("unresolved")).when(decided, F.lit("high")).otherwise(c("status")).alias("status"),
        F.when(decided, F.lit(False)).otherwise(c("review_required")).alias("review_required"),
        F.coalesce(c("action"), F.lit("")).alias("review"),
    )
