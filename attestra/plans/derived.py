"""Relations that resolution queries run on, made from the driver's whole tables by arithmetic on their keys.

The driver's tables hold no product titles or catalogues. Each row of part becomes a listing of a catalogue, each row of customer a
request with its evidence, web rows and verdicts. One text of expressions, in words that Spark and the oracles' engine share, makes
the inputs on both sides; what the operators do with them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

PHRASES = [
    "Nike Dunk Low Retro", "Air Jordan 1 Retro High OG", "adidas Samba OG", "New Balance 990v6", "Nike Air Force 1 ''07 LV8", "Jordan 4 Retro", "Nike Dunk High", "Air Jordan 1 Little Kids Low",
    "Travis Scott x Air Jordan 1 Low", "ASICS Gel-Kayano 14", "Nike Dunk", "plain canvas shoe", "Yeezy Boost 350 V2", "Nike SB Dunk Low Pro", "Air Jordan 11 Retro", "Vans Old Skool",
]
SIZES = ["", " (GS)", " Women''s", " Men''s", "", " WMNS", " (TD)", " Little Kids", ""]
COLOURS = ["White/Black", "Black/White", "Off White/Black", "University Red", "Panda", "Sail/Gum", "Core Black & Gold", "Bred", "", "White and Varsity Red", "Reverse Panda"]


def pick(key: str, words: list[str]) -> str:
    return f"CASE ({key}) % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def digits(key: str) -> str:
    return f"lpad(CAST(({key}) % 1500 AS STRING), 4, '0')"


def code(key: str) -> str:
    """A code as it is printed; keys 1500 apart share one."""
    return f"concat('DD', {digits(key)}, '-10', CAST(({key}) % 3 AS STRING))"


def plain(key: str) -> str:
    return f"concat('DD', {digits(key)}, '10', CAST(({key}) % 3 AS STRING))"


def title(key: str) -> str:
    colour = pick(f"({key}) * 5 + 1", COLOURS)
    return f"concat({pick(key, PHRASES)}, {pick(f'({key}) * 4 + 2', SIZES)}, CASE WHEN ({key}) % 7 = 0 THEN concat(' ''', {colour}, '''') ELSE concat(' ', {colour}) END)"


def number(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


#: name: (table, rows of each row of the table, expressions by column); k counts the rows of one row, n is its key.
RELATIONS: dict[str, tuple[str, str, int, dict[str, str]]] = {
    "listings_raw": ("part", "p_partkey", 1, {
        "product_id": "concat('p', CAST(n AS STRING))",
        "style_id": f"CASE WHEN n % 10 = 0 THEN concat({code('n')}, '/FV', {digits('n')}, '-006') WHEN n % 10 = 1 THEN concat({code('n')}, ' (GS)') ELSE {code('n')} END",
        "title": title("n * 3 + 1"),
        "brand": pick("n", ["Nike", "Jordan", "adidas", "", "New Balance", "nobody", "Nike"]),
        "colorway": pick("n * 5 + 4", COLOURS),
        "gender": pick("n", ["men", "women", "child", "unisex", "", "toddler", "Men"]),
        "release_date": "CASE WHEN n % 4 = 0 THEN '' ELSE '2021-03-10' END",
        "retail_price": f"CASE WHEN n % 9 = 0 THEN NULL ELSE {number('80 + n % 90')} END",
        "product_type": pick("n", ["sneakers", "shoes", "sneakers", "sneakers", "", "Running Shoe", "sneakers", "apparel", "sneakers", "clog", "sneakers"]),
        "ord": "n",
    }),
    "requests_raw": ("customer", "c_custkey", 1, {
        "query_id": "n",
        "title": f"CASE WHEN n % 13 = 5 THEN '' ELSE {title('n * 3 + CASE WHEN n % 5 = 0 THEN 4 ELSE 1 END')} END",
        "page_brand": pick("n", ["Nike", "", "Jordan", "adidas", "Shop", "", ""]),
        "price": f"CASE WHEN n % 6 = 0 THEN NULL ELSE {number('40 + n % 100')} END",
        "page_colour": pick("n", ["", "White/Black", "", "Black", "", "", "Gum"]),
        "labeled": f"CASE WHEN n % 3 = 0 THEN {plain('n')} WHEN n % 17 = 1 THEN concat({plain('n + 1')}, ',', {plain('n + 2')}) ELSE '' END",
        "seen": "n % 4 <> 0",
        "v_brand": pick("n", ["Nike", "Nike", "adidas", "Jordan", ""]),
        "v_brand_confidence": number("n % 11 / 10.0"),
        "v_model": pick("n", ["Nike Dunk Low", "Air Jordan 1 High", "", "Nike Dunk", "adidas Samba OG", "Air Jordan 4"]),
        "v_model_confidence": number("n % 9 / 8.0"),
        "v_colorway": pick("n * 5 + 1", COLOURS),
        "v_official": pick("n", ["", "Panda", "", "University Red", "Reverse Panda", "White Black"]),
        "v_gender": pick("n", ["men", "women", "", "unknown"]),
        "v_size_category": pick("n", ["adult", "gs", "unknown", "adult", ""]),
        "v_style_code": f"CASE WHEN n % 8 = 3 THEN {code('n')} WHEN n % 8 = 5 THEN {code('n + 1')} ELSE '' END",
        "guesses": f"CASE WHEN n % 5 = 2 THEN concat({code('n + 1')}, ',nothing,', {code('n')}) ELSE '' END",
        "v_consistent": "n % 10 <> 7",
    }),
    # Codes on pages, visual neighbours and web finds of each request; k tells which.
    "signals_raw": ("customer", "c_custkey", 7, {
        "query_id": "n",
        "kind": pick("k", ["page_sku", "embedding", "web", "embedding", "web", "embedding", "page_sku"]),
        # The code of the last row is in no catalogue.
        "style_code": f"CASE WHEN k = 6 THEN concat('ZZ', {digits('n')}, '001') ELSE {plain('n + CASE k WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END')} END",
        "display": f"CASE WHEN k = 6 THEN concat('ZZ', {digits('n')}, '-001') ELSE {code('n + CASE k WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END')} END",
        "detail": pick("n + k", ["page:title", "page:body", "page:url"]),
        "weight": number("45 + (n * 7 + k * 5) % 51") + " / 100",
        "similarity": number("60 + (n * 37 + k * 11) % 40") + " / 100",
        "agreement": "1 + (n + k) % 4",
        "trust": number("(n + k) % 5 * 6") + " / 10",
        "ord": "k",
        "there": "(n + k) % 4 <> 1 AND n % 29 <> 3",
    }),
    "results_raw": ("customer", "c_custkey", 3, {
        "query_id": "n",
        "ord": "k",
        "url": f"concat('https://', {pick('n + k * 2', ['www.nike.com', 'goat.com', 'ebay.com', 'blog.example.org', 'goat.com'])}, '/p/', CAST(n AS STRING))",
        "title": f"CASE WHEN (n + k) % 6 = 2 THEN '' ELSE concat('Nike shoe ', {code('n + k % 2')}) END",
        "snippet": f"CASE WHEN (n + k) % 3 = 0 THEN concat('Style: ', {code('n')}, ' and ', {code('n + 3')}, ' or ', {code('n + 4')}) WHEN (n + k) % 3 = 1 THEN concat('nike ', {code('n + 1')}) ELSE 'sold out' END",
        "width": "100 * ((n + k) % 7)",
        "height": "100 * ((n + k * 3) % 5)",
    }),
    "outcomes_raw": ("customer", "c_custkey", 1, {
        "query_id": "n",
        "expected": code("n"),
        "got": f"CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 THEN {plain('n + 1')} ELSE {plain('n')} END",
        "ranked": f"concat({plain('n + 1')}, ',', CASE WHEN n % 4 = 0 THEN {plain('n + 2')} ELSE {plain('n')} END, ',', {plain('n + 3')}, ',', {plain('n')})",
        "status": pick("n", ["high", "medium", "low", "unresolved", "medium", "low", "high"]),
        "product_id": "CASE WHEN n % 3 = 0 THEN NULL ELSE concat('p', CAST(n AS STRING)) END",
        "expected_product_id": "CASE WHEN n % 2 = 0 THEN '' ELSE concat('p', CAST(n % 50 AS STRING)) END",
        "ms": "(n * 37) % 901",
        "confidence": number("60 + n % 40") + " / 100",
        "review_required": "n % 7 IN (2, 3, 5)",
        "reviewed": "n % 9 = 2",
    }),
    # The own database: products of codes in the catalogue and of others; a code may be told of more than once.
    "known_raw": ("customer", "c_custkey", 1, {
        "style_code": f"CASE WHEN n % 2 = 0 THEN concat('ZZ', {digits('n')}, '001') ELSE {plain('n')} END",
        "name": f"CASE WHEN n % 7 = 3 THEN '' ELSE {title('n * 5 + 2')} END",
        "brand": pick("n", ["Nike", "", "adidas", "Jordan"]),
        "model": pick("n", ["", "Nike Dunk Low", ""]),
        "colorway": pick("n * 3 + 1", COLOURS),
        "gender": pick("n", ["men", "", "women"]),
        "size_category": pick("n", ["adult", "gs", ""]),
        "release_date": "CASE WHEN n % 3 = 0 THEN '' ELSE '2020-02-02' END",
        "retail_price": f"CASE WHEN n % 4 = 0 THEN NULL ELSE {number('70 + n % 80')} END",
        "ord": "n",
    }),
    "decisions_raw": ("customer", "c_custkey", 3, {
        "query_id": "n",
        "action": pick("n * 2 + k", ["confirm", "reject", "select", "manual_sku", "nonsense"]),
        "chosen": f"CASE WHEN (n + k) % 3 = 0 THEN '' ELSE {plain('n + k')} END",
        "decided_at": "(n * 7 + k * 5) % 11",
        "ord": "k",
        "there": "(n + k) % 2 = 0 AND n % 5 < 3",
    }),
    "verdicts_raw": ("customer", "c_custkey", 2, {
        "query_id": "n",
        "style_code": plain("n + k"),
        "verdict": pick("n + k", ["same", "different", " Uncertain", "SAME", "unheard of"]),
        "confidence": number("60 + n % 40") + " / 100",
        "note": "CASE WHEN n % 2 = 0 THEN 'sole differs' ELSE '' END",
        "there": "(n + k) % 3 = 1",
    }),
}


def shape(rows: DataFrame, name: str) -> DataFrame:
    """The relation that rows of its table give, in a batch or a stream."""
    _, key, copies, columns = RELATIONS[name]
    out = rows.selectExpr(f"{key} AS n", f"explode(sequence(0, {copies - 1})) AS k").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    return out.where("there").drop("there") if "there" in columns else out


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation of a name; only keys are dealt out, what is made of them is made where they are."""
    file, key, *_ = RELATIONS[name]
    return shape(spread(spark.read.parquet(f"{sf_dir}/{file}.parquet").select(key), key), name)


def sql(name: str) -> str:
    """name AS (...) for a WITH clause."""
    table, key, copies, columns = RELATIONS[name]
    out = f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM (SELECT {key} AS n, unnest(range({copies})) AS k FROM {table})"
    return f"{name} AS (SELECT * FROM ({out}){' WHERE there' if 'there' in columns else ''})"


#: Pages as fetched from a shop: the address asked for, the one redirected to, the page with linked data; and the shop platform's JSON.
ASKED = """CASE WHEN page_id % 19 = 4 THEN 'http://10.0.0.7/x' WHEN page_id % 19 = 9 THEN 'ftp://shop.example.com/x' ELSE concat('https://shop.example.com/', CASE WHEN page_id % 3 = 0 THEN 'products/' ELSE 'p/' END, 'item-', CAST(page_id AS STRING), '?ref=mail') END"""
FINAL_URL = """CASE WHEN page_id % 4 = 1 THEN concat('https://shop.example.com/en/products/moved-', CAST(page_id AS STRING)) WHEN page_id % 4 = 2 THEN '' WHEN page_id % 31 = 8 THEN 'http://192.168.0.9/' ELSE asked END"""
LINKED = """concat('{"@type": "Product", "name": "Nike Dunk Low ', CAST(page_id AS STRING), '", "brand": {"name": "NIKE"}, "description": "<b>Shoe</b>", "sku": "DD', lpad(CAST(page_id % 1500 AS STRING), 4, '0'), '-100", "image": ["/a/', CAST(page_id AS STRING), '.jpg", "/a/', CAST(page_id AS STRING),
    '.jpg?w=2"], "offers": [{"price": "', CAST(80 + page_id % 90 AS STRING), '.5", "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}]}')"""
FETCHED_HTML = f"""CASE WHEN page_id % 23 = 6 THEN NULL WHEN page_id % 5 < 2 THEN replace(html, '</head>', concat('<script type="application/ld+json">', {LINKED}, '</script></head>')) ELSE html END"""
PLATFORM_KEY = """concat('https://shop.example.com', CASE WHEN page_id % 2 = 0 THEN '/products/item-' ELSE '/products/moved-' END, CAST(page_id AS STRING), '.json')"""
PLATFORM_JSON = """concat('{"product": {"title": "Air Jordan ', CAST(page_id AS STRING), '", "vendor": "Jordan", "variants": [{"sku": "FV', lpad(CAST(page_id % 1500 AS STRING), 4, '0'), '-006", "price": "99.00", "option1": "US 9"}]}}')"""

#: Raw JSON of a catalogue, its variants and its market, from parts and line items.
PRODUCT_JSON = """CASE WHEN p_partkey % 13 = 5 THEN '{broken' ELSE concat('{"', CASE WHEN p_partkey % 11 = 3 THEN 'noId' WHEN p_partkey % 2 = 0 THEN 'id' ELSE 'productId' END, '": "', CAST(p_partkey AS STRING), '", "styleId": "DD', CAST(p_partkey AS STRING), '", "title": "', p_name, '", "brand": "', p_brand,
    '", "productType": "', p_type, '", "productAttributes": {"colorway": "', p_name, '", "gender": ', CASE WHEN p_size > 25 THEN '"men"' ELSE 'null' END, ', "retailPrice": "', CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE concat('$1,', CAST(100 + p_partkey % 900 AS STRING), '.5') END, '"}}') END"""
VARIANT_JSON = """concat('{"variantId": "', CASE WHEN p_partkey % 10 = 9 THEN '' ELSE concat('v', CAST(p_partkey AS STRING)) END, '", "variantValue": "', CAST(p_size AS STRING), 'v", "sizeChart": {"defaultConversion": {"size": "', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size AS STRING) END, '", "type": "', CASE WHEN p_partkey % 3 = 0 THEN 'US W' ELSE 'us m' END, '"}}}')"""
MARKET_JSON = """concat('{"variantId": "v', CAST(l_partkey AS STRING), '", "variantValue": ', CASE WHEN l_linenumber % 2 = 0 THEN '"x"' ELSE 'null' END, ', "lowestAskAmount": "', CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) ELSE '0' END, '", "standardMarketData": {"lowestAsk": ', CASE WHEN l_returnflag = 'A' THEN '"77"' ELSE 'null' END,
    ', "highestBidAmount": ', CASE WHEN l_linestatus = 'F' THEN '"$5"' ELSE 'null' END, '}}')"""
