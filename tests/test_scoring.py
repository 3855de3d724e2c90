"""Scenarios of evidence: a printed code, web agreement, verdicts, colourways, sizes, models, ambiguity, rejections."""

import pytest
from pyspark.sql import functions as F

from attestra.operators import catalog, observe, scoring

REQUEST = (
    "query_id long, title string, page_brand string, price double, page_colour string, labeled_codes array<string>, seen boolean, v_brand string, v_brand_confidence double, v_model string, v_model_confidence double, "
    "v_colorway string, v_official string, v_gender string, v_size_category string, v_style_code string, v_guesses array<string>, v_consistent boolean"
)
LISTING = "product_id string, style_id string, title string, brand string, colorway string, gender string, release_date string, retail_price double, product_type string, ord long"
PANDA = ("p1", "DD1391-100", "Nike Dunk Low Retro White Black Panda (2021)", "Nike", "White/Black", "men", "2021-03-10", 110.0, "sneakers", 1)
REVERSE = ("p2", "DJ6188-002", "Nike Dunk Low Reverse Panda", "Nike", "Black/White", "men", "", 110.0, "sneakers", 2)
CHILD = ("p3", "CW1590-100", "Nike Dunk Low Retro White Black (GS)", "Nike", "White/Black", "child", "", 90.0, "sneakers", 3)
HIGH = ("p4", "DD1399-105", "Nike Dunk High Retro White Black Panda", "Nike", "White/Black", "men", "", None, "sneakers", 4)
AGAIN = ("p5", "FD9064-011", "Nike Dunk Low Retro White Black Panda (2024)", "Nike", "White/Black", "men", "", 115.0, "sneakers", 5)
TEE = ("p9", "DD1391-100", "Nike Panda Tee", "Nike", "", "", "", None, "apparel", 9)
P, R, G, H, A = "DD1391100", "DJ6188002", "CW1590100", "DD1399105", "FD9064011"


def asked(n, title, price=109.99, codes=(), photos=True, **seen):
    shown = {"brand": "Nike", "brand_confidence": 0.95, "model": "Nike Dunk Low", "model_confidence": 0.9, "colorway": "White/Black", "official": "Panda", "gender": "men", "size_category": "adult", "style_code": "", "guesses": [], "consistent": True} | seen
    names = ("brand", "brand_confidence", "model", "model_confidence", "colorway", "official", "gender", "size_category", "style_code", "guesses", "consistent")
    return (n, title, "Nike" if title else "", price, "", list(codes), photos, *[shown[c] if photos else None for c in names])


#: query: request, evidence (code, kind, weight, similarity), web rows (code, agreement, trust), verdicts, listings
CASES = {
    1: (asked(1, "Nike Dunk Low Retro White Black", codes=[P]), [(P, "page_sku", 0.9, 0.93)], [], [], [PANDA]),
    2: (asked(2, "Nike Dunk Low Retro White / Black"), [(P, "web", 1.0, 0.9)], [(P, 3, 3.0)], [], [PANDA]),
    3: (asked(3, "Nike Dunk Low Retro White / Black"), [(P, "web", 1.0, 0.9), (R, "catalog_search", 0.2, 0.8)], [(P, 3, 3.0)], [(P, "same", 0.9, []), (R, "different", 0.9, ["black base"])], [PANDA, REVERSE]),
    4: (asked(4, "Nike Dunk Low Retro White Black", codes=[P]), [(P, "embedding", 0.9, 0.9), (R, "embedding", 0.86, 0.86)], [], [], [PANDA, REVERSE]),
    5: (asked(5, "Nike Dunk Low Retro White Black Men's"), [(P, "embedding", 0.9, 0.9), (G, "embedding", 0.91, 0.91)], [], [], [PANDA, CHILD]),
    6: (asked(6, "Nike Dunk Low (GS) White Black", 89.99, size_category="gs"), [(P, "embedding", 0.9, 0.9), (G, "embedding", 0.9, 0.9)], [], [], [PANDA, CHILD]),
    7: (asked(7, "Nike Dunk Low Retro White Black", None), [(P, "embedding", 0.9, 0.9), (H, "embedding", 0.92, 0.92)], [], [], [PANDA, HIGH]),
    8: (asked(8, "Nike Dunk Low Retro White Black", 110.0), [(P, "embedding", 0.9, 0.9), (A, "embedding", 0.9, 0.9)], [], [], [PANDA, AGAIN]),
    9: (asked(9, "", None, photos=False), [], [], [], []),
    10: (asked(10, "Nike Dunk Low Retro", None, style_code="DD1391-100"), [(P, "vision_tag", 0.9, None), (R, "catalog_search", 0.2, None)], [], [], [PANDA, REVERSE]),
    11: (asked(11, "Nike Dunk Low Retro White Black", codes=[P]), [(P, "page_sku", 0.9, 0.95)], [], [(P, "uncertain", 0.5, [])], [PANDA]),
    12: (asked(12, "Nike Dunk Low Retro", None), [(P, "catalog_search", 0.2, None)], [], [], [TEE]),
    13: (asked(13, "Nike Dunk Low Retro White Black", codes=["XX0000001"]), [("XX0000001", "page_sku", 0.9, None)], [], [], []),
    14: (asked(14, "Nike Dunk Low", None, model="Nike Dunk High", consistent=False), [(P, "web", 0.5, None)], [], [], [PANDA]),
    15: (asked(15, "", None, brand="adidas", brand_confidence=0.6, model="adidas Samba", model_confidence=0.6, size_category="gs"), [(P, "embedding", 0.8, 0.8)], [], [], [PANDA]),
    16: (asked(16, "Travis Scott x Nike Dunk Low", None, photos=False), [(P, "vision_guess", 0.35, None)], [], [], [PANDA]),
    17: (asked(17, "Nike Dunk", None, photos=False), [(P, "page_sku", 0.5, None)], [], [], [PANDA]),
}


@pytest.fixture(scope="module")
def results(spark):
    """Every case alone: by query, candidates by code, and the resolution."""
    from attestra.session import ship_package

    ship_package(spark)
    requests = spark.createDataFrame([c[0] for c in CASES.values()], REQUEST)
    evidence = spark.createDataFrame([(q, code, code, kind, kind, weight, sim, i) for q, c in CASES.items() for i, (code, kind, weight, sim) in enumerate(c[1])], "query_id long, style_code string, display string, kind string, detail string, weight double, similarity double, ord long")
    web = spark.createDataFrame([(q, *w) for q, c in CASES.items() for w in c[2]], "query_id long, style_code string, agreement long, trust double")
    verdicts = spark.createDataFrame([(q, *v) for q, c in CASES.items() for v in c[3]], "query_id long, style_code string, verdict string, confidence double, contradictions array<string>")
    # A catalogue of its own for each case.
    listed = None
    for q, c in CASES.items():
        if c[4]:
            own = catalog.listings(spark.createDataFrame(c[4], LISTING)).withColumn("q", F.lit(q))
            listed = own if listed is None else listed.unionByName(own)
    listed = spark.createDataFrame(listed.collect(), listed.schema)
    pool = observe.pool(evidence).withColumn("code", F.col("style_code")).withColumn("style_code", F.concat_ws("/", "query_id", "style_code"))
    own = catalog.overlay(pool, listed.withColumn("style_code", F.concat_ws("/", "q", "style_code"))).withColumn("style_code", F.col("code"))
    observed = observe.observe(requests)
    judged = scoring.verify(scoring.contradict(scoring.score(scoring.pair(own, observed, web))), verdicts)
    judged = spark.createDataFrame(judged.collect(), judged.schema)
    queries = requests.select("query_id", "labeled_codes", F.lit(True).alias("confirmed"))
    by_code = {}
    for r in judged.collect():
        by_code.setdefault(r.query_id, {})[r.style_code] = r
    return by_code, {r.query_id: r for r in scoring.resolve(queries, judged).collect()}, judged


def test_a_printed_code_that_the_catalogue_confirms_is_high(results):
    by_code, resolved, _ = results
    c = by_code[1][P]
    assert c.c_sku == 1.0 and c.c_model == 1.0 and c.c_colorway >= 0.9 and not c.rejected and c.contradictions == []
    assert (resolved[1].status, resolved[1].style_code, resolved[1].page_confirmed) == ("high", P, True)


def test_without_a_printed_code_high_needs_the_verifier(results):
    by_code, resolved, _ = results
    assert (resolved[2].status, resolved[2].style_code) == ("medium", P)
    assert by_code[2][P].c_sku == pytest.approx(0.35 + 0.45 + 0.2)
    assert resolved[3].status == "high" and by_code[3][R].rejected and "verifier:black base" in by_code[3][R].contradictions and by_code[3][R].rejection_reason == "verifier:different"


def test_colourways_sizes_models(results):
    by_code, resolved, _ = results
    assert by_code[4][P].c_colorway > by_code[4][R].c_colorway and by_code[4][P].score > by_code[4][R].score
    assert "page_style_code_mismatch" in by_code[4][R].contradictions
    assert by_code[5][G].rejection_reason == "size_category_mismatch" and resolved[5].style_code == P
    assert by_code[6][P].rejected and not by_code[6][G].rejected
    assert by_code[7][H].rejection_reason == "model_mismatch"


def test_ambiguity_none_tags_doubt_and_apparel(results):
    by_code, resolved, _ = results
    assert resolved[8].failure == "MULTIPLE_CANDIDATES" and resolved[8].status in ("low", "unresolved") and resolved[8].confidence < 0.85
    assert (resolved[9].status, resolved[9].failure, resolved[9].style_code) == ("unresolved", "NO_CANDIDATES", None)
    assert "tag_style_code_mismatch" in by_code[10][R].contradictions and by_code[10][P].c_sku == 0.9
    assert resolved[11].status != "high" and resolved[11].confidence <= 0.84
    assert by_code[12][P].rejection_reason == "product_type" and resolved[12].failure == "CONTRADICTORY_EVIDENCE"
    assert resolved[13].failure == "CATALOG_MATCH_UNCERTAIN" and "no_catalog_identity" in by_code[13]["XX0000001"].contradictions and resolved[13].confidence <= 0.69


def test_photos_alone_weigh_but_do_not_reject_unless_certain(results):
    by_code, _, _ = results
    assert by_code[14][P].rejection_reason == "model_mismatch" and "query_images_inconsistent" in by_code[14][P].contradictions
    unsure = by_code[15][P]
    assert not unsure.rejected and {"size_category_mismatch_in_photos", "model_mismatch_in_photos", "brand_mismatch_in_photos"} <= set(unsure.contradictions)
    assert by_code[14][P].c_sku == pytest.approx(0.35 + 0.15 + 0.05)  # web evidence without a web row: one domain of trust 0.5
    assert "collab_missing" in by_code[16][P].contradictions
    assert "model_height_unspecified" in by_code[17][P].contradictions and by_code[17][P].c_model == 0.6 and by_code[17][P].c_sku == 0.8


def test_finalize_and_override(spark, results):
    _, _, judged = results
    resolved = scoring.resolve(spark.createDataFrame([(q, True, [P]) for q in CASES], "query_id long, confirmed boolean, labeled_codes array<string>"), judged)
    failures = spark.createDataFrame([(1, ["CONTRADICTORY_EVIDENCE"]), (2, ["NO_SKU"])], "query_id long, codes array<string>")
    listed = spark.createDataFrame([(1, "p1", "t", False, 90.0, 120.0), (13, "p3", "t", True, 5.0, 6.0)], "query_id long, product_id string, title string, confirmed boolean, lowest_ask double, highest_bid double")
    rows = {r.query_id: r for r in scoring.finalize(resolved, judged, failures, listed).collect()}
    assert rows[1].status == "medium" and rows[1].confidence >= 0.95 and rows[1].match_confidence == 0.84 and (rows[1].lowest_ask, rows[1].brand, rows[1].model) == (90.0, "Nike", "Nike Dunk Low")
    assert rows[2].failures == "NO_SKU" and not rows[2].review_required and rows[13].lowest_ask is None and rows[13].review_required
    decisions = spark.createDataFrame([(1, "reject", None, 1, 1), (1, "confirm", None, 2, 2), (5, "reject", "", 1, 1), (8, "select", A, 3, 1), (2, "manual_sku", "", 9, 9), (3, "nonsense", P, 1, 1)], "query_id long, action string, chosen string, decided_at long, ord long")
    got = {r.query_id: r for r in scoring.override(resolved.withColumn("review_required", F.lit(True)), decisions).collect()}
    assert (got[1].style_code, got[1].confidence, got[1].status, got[1].review_required) == (P, 1.0, "high", False)
    assert (got[5].style_code, got[5].status) == (None, "unresolved") and got[8].style_code == A and got[2].review == "" and got[2].review_required and got[3].review == ""
