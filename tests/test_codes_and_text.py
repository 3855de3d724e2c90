import pytest
from pyspark.sql import functions as F

from attestra.functions import codes, text, urls

DETECT = [
    # text, hint, codes that must be found first, codes that must be absent
    ("Nike Dunk Low Retro. Style: DD1391-100. Color: White/Black", "", ["DD1391100"], []),
    ("Air Jordan 4 Retro Bred Reimagined FV5029-006 men's", "", ["FV5029006"], []),
    ("Promo DD1391100 in stock", "", [], ["DD1391100"]),
    ("Nike Dunk Low DD1391100 in stock", "", ["DD1391100"], []),
    ("Released 2024-03-15, was $120.00, UPC 196155451231, order 20240315", "", [], ["20240315", "196155451231"]),
    ("Some product GX8862 here", "", [], ["GX8862"]),
    ("adidas Samba OG GX8862", "", ["GX8862"], []),
    ("Article number: IE1234", "", ["IE1234"], []),
    ("New Balance 990v6 M990GL6", "", ["M990GL6"], []),
    ("ASICS Gel-Kayano 14 1201A019-020", "", ["1201A019020"], []),
    ("New Balance 9060 Sea Salt U9060ECC", "", ["U9060ECC"], []),
    ("Vans Old Skool SKU: VN0A38G1EO2", "", ["VN0A38G1EO2"], []),
    ("Converse Chuck 70 Style # 162050C", "", ["162050C"], []),
    ("Salomon XT-6 style code L47293900", "", ["L47293900"], []),
    ("Nike Air Force 1 '07 white promo GX8862 shipping", "", [], ["GX8862"]),
    ("Nike shoe DD1391 100 here", "", ["DD1391100"], []),
    ("size DV0831-101-10.5", "nike", ["DV0831101"], []),
    (None, "", [], []),
]


def test_code_detection(spark):
    df = spark.createDataFrame([(i, t, h, 0.5) for i, (t, h, _, _) in enumerate(DETECT)], "case_id long, text string, brand_hint string, base_confidence double")
    got: dict[int, dict] = {}
    for r in codes.detect_codes(df).collect():
        got.setdefault(r.case_id, {})[r.code] = r
    for i, (t, _, there, absent) in enumerate(DETECT):
        found = got.get(i, {})
        assert set(there) <= set(found), (t, set(found))
        assert not set(absent) & set(found), (t, set(found))
    first = got[0]["DD1391100"]
    assert first.labeled and first.confidence >= 0.85 and first.display == "DD1391-100"
    assert got[16]["DV0831101"].display == "DV0831-101"


@pytest.mark.parametrize("title,gender,size", [("Women's x", "women", "adult"), ("Big Kids' x", "kids", "gs"), ("x (TD)", "kids", "td"), ("Little Kids x", "kids", "ps"), ("Men's x", "men", "adult"), ("wmns x", "women", "adult"), ("x", "unknown", "unknown"), (None, "unknown", "unknown")])
def test_gender_and_size(spark, title, gender, size):
    r = spark.createDataFrame([(title,)], "t string").select(text.gender(F.col("t")).alias("g"), text.size_category(F.col("t")).alias("s")).first()
    assert (r.g, r.s) == (gender, size)


COLOURS = [
    ("White/Black-Gum", ["white", "black", "gum"]), ("Sail/University Red", ["sail", "university red"]), ("WHT/BLK", ["white", "black"]), ("Off White & Univ Red", ["off white", "university red"]),
    ("off-white/offwhite", ["off white"]), ("lt grey and (dk) red", ["light", "grey", "dark", "red"]), ("xoff white", ["white"]), ("Panda 'Black Cat'", ["panda", "black"]),
    ("Summit White–Photon Dust|Gold", ["summit white", "photon dust", "gold"]), ("university red.", []), ("plain", []), (None, []),
]


def test_colour_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(COLOURS)], "i int, t string")
    assert [r.c for r in df.select("i", text.colour_tokens(F.col("t")).alias("c")).orderBy("i").collect()] == [c for _, c in COLOURS]


PAIRS = [
    ("White/Black", "White/Black", 1.0), ("White/Black", "Black/White", 0.7), ("", "White", None), ("Off White/Black", "White/Black", 1 / 3), ("University Red", "Varsity Red", 0.0),
    ("Panda", "White/Black", None), ("Panda", "Reverse Panda", 0.5), ("White Panda", "White Reverse Panda", 0.5), ("Core Black", "Black", 0.0), ("Panda/White", "Bred", 0.0),
]


def test_colour_similarity(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, a string, b string, s double")
    for r in df.select("i", "s", text.colour_similarity(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(r.s) if r.s is not None else r.got is None, PAIRS[r.i]


def test_families_and_identifiers(spark):
    rows = [("Nike SB", "nike"), ("Air Jordan", "nike"), ("NEW BALANCE", "new balance"), ("nobody", ""), (None, "")]
    assert [r[0] for r in spark.createDataFrame(rows, "b string, f string").coalesce(1).select(text.known_family(F.col("b"))).collect()] == [f for _, f in rows]
    rows = [("DV0831-101-10.5", "nike", "DV0831101"), ("12345", "", None), (None, "", None), ("CD0461", "nike", None), ("GX8862", "", "GX8862")]
    got = spark.createDataFrame(rows, "v string, h string, c string").coalesce(1).select("c", codes.identifier_code(F.col("v"), F.col("h")).alias("x")).collect()
    assert [r.x and r.x.code for r in got] == [c for _, _, c in rows] and got[0].x.display == "DV0831-101" and got[0].x.confidence == 0.9
    days = [("20240315", True), ("20241301", False), ("202403", True), ("189912", False), ("196155451231", True), ("DD1391100", False), ("123456789", False)]
    assert [r[0] for r in spark.createDataFrame(days, "n string, x boolean").coalesce(1).select(codes.implausible(F.col("n"))).collect()] == [x for _, x in days]


def test_urls(spark):
    rows = [("HTTPS://WWW.Shop.Example/a/b/?x=1#y", "https://www.shop.example/a/b", "shop.example"), ("http://e.org/a;p=1", "http://e.org/a", "e.org"), (None, "", ""), ("nonsense", "", "")]
    for u, key, domain in rows:
        r = spark.createDataFrame([(u,)], "u string").select(urls.normalize_url(F.col("u")).alias("k"), urls.domain(F.col("u")).alias("d")).first()
        assert (r.k, r.d) == (key, domain)
