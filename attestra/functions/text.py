"""Brands, gender, size category and colour names of product texts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Brand and its aliases, in order of precedence; an alias must start a word (fixed values).
BRANDS = [
    ("Jordan", ["air jordan", "jordan brand", "jordan"]),
    ("Nike", ["nike sb", "nike", "nikelab", "nike acg"]),
    ("adidas", ["adidas originals", "adidas", "yeezy", "y-3"]),
    ("New Balance", ["new balance", "nb"]),
    ("ASICS", ["asics", "asics sportstyle"]),
    ("Converse", ["converse"]),
    ("Vans", ["vans", "vault by vans"]),
    ("Puma", ["puma"]),
    ("Reebok", ["reebok"]),
    ("Salomon", ["salomon"]),
    ("On", ["on running", "on cloud", "on "]),
    ("Hoka", ["hoka one one", "hoka"]),
    ("Under Armour", ["under armour", "ua curry", "curry brand"]),
    ("Saucony", ["saucony"]),
    ("Timberland", ["timberland"]),
    ("UGG", ["ugg"]),
    ("Crocs", ["crocs"]),
    ("Birkenstock", ["birkenstock"]),
    ("Dr. Martens", ["dr. martens", "dr martens", "doc martens"]),
    ("Balenciaga", ["balenciaga"]),
    ("Gucci", ["gucci"]),
    ("Louis Vuitton", ["louis vuitton"]),
    ("Bape", ["a bathing ape", "bape"]),
    ("Golden Goose", ["golden goose"]),
    ("Common Projects", ["common projects"]),
    ("Fear of God", ["fear of god", "essentials"]),
    ("Maison Margiela", ["maison margiela", "margiela", "mm6"]),
]
#: What removing the aliases one after another takes out of a text: one that holds an earlier one is never found whole.
ALIASES = [a for _, names in BRANDS for a in names]
REMOVED = [a for i, a in enumerate(ALIASES) if not any(f" {b} " in f" {a} " for b in ALIASES[:i])]
#: (size category, pattern) then (gender, pattern), in order of precedence (fixed values).
CATEGORIES = [
    ("td", r"\(td\)|\btd\b|toddlers?|\binfants?\b|\bbaby\b|crib"),
    ("ps", r"\(ps\)|\bps\b|pre-?school|little\s*kids?"),
    ("gs", r"\(gs\)|\bgs\b|grade\s*school|big\s*kids?|\byouth\b|\bkids'?\b|\bjunior\b|\bjr\b"),
]
GENDERS = [
    ("women", r"\(w\)|\bwmns\b|\bwomen'?s?\b|\bwoman'?s?\b|\bwmn\b|\bladies\b|\bfemale\b"),
    ("men", r"\bmen'?s?\b|\bmens\b|\bmale\b"),
]
#: What a colour word or phrase is called (fixed values); phrases of several words become one token.
SYNONYMS = {
    "wht": "white", "blk": "black", "gry": "grey", "gray": "grey", "univ red": "university red", "university red": "university red",
    "varsity red": "varsity red", "gym red": "gym red", "sail": "sail", "cream": "cream", "off white": "off white", "offwhite": "off white",
    "off-white": "off white", "midnight navy": "midnight navy", "navy": "navy", "royal": "royal", "game royal": "game royal",
    "photon dust": "photon dust", "wolf grey": "wolf grey", "cool grey": "cool grey", "smoke grey": "smoke grey", "lt": "light", "dk": "dark",
    "pnk": "pink", "grn": "green", "ylw": "yellow", "pur": "purple", "org": "orange", "brn": "brown", "gum": "gum", "coconut milk": "coconut milk",
    "phantom": "phantom", "summit white": "summit white", "pale ivory": "pale ivory", "sesame": "sesame", "bone": "bone",
    "cloud white": "cloud white", "core black": "core black", "collegiate green": "collegiate green", "sea salt": "sea salt",
    "moonbeam": "moonbeam", "aluminum": "aluminum", "silver": "silver", "metallic silver": "metallic silver", "metallic gold": "metallic gold",
    "gold": "gold",
}
#: Colour words by themselves (fixed values).
COLOURS = (
    "white black grey red blue green yellow orange purple pink brown navy royal sail cream gum gold silver tan beige teal burgundy maroon olive khaki ivory bone phantom sesame "
    "mint lilac coral turquoise aqua crimson scarlet bred chicago panda mocha obsidian volt infrared cement military neutral light dark pale metallic wolf cool smoke university "
    "varsity gym midnight photon dust summit core cloud collegiate sea salt moonbeam aluminum coconut milk game pine malachite lucky medium true bright sport team anthracite iron "
    "particle platinum hemp wheat mushroom taupe rattan sand desert stone concrete graphite carbon ash chalk linen oatmeal cacao chocolate espresso walnut hazel amber rust copper "
    "bronze brass"
).split()
#: Release nicknames and qualifiers, compared with each other and never with colours (fixed values).
NICKNAMES = (
    "panda bred chicago mocha reverse inverse alternate alt next nature shadow royal pine lucky toe cement military cactus jack fragment og"
).split()
#: Colours that can lead a colourway (fixed values).
PRIMARIES = (
    "white black grey red blue green yellow orange purple pink brown navy sail cream gum gold silver tan beige teal olive royal burgundy maroon obsidian bone ivory khaki phantom"
).split()
#: Phrases that are one token, the longest first.
PHRASES = sorted((x for x, name in SYNONYMS.items() if " " in x + name or "-" in x), key=lambda x: -len(x))
KNOWN = sorted({*COLOURS, *NICKNAMES, *SYNONYMS.values()})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row."""
    return F.transform(F.array(value), body).getItem(0)


def known_brand(text: Column) -> Column:
    """First brand with an alias at the start of a word, else empty."""

    def first(padded: Column) -> Column:
        chain = F.lit("")
        for brand, aliases in reversed(BRANDS):
            found = F.lit(False)
            for a in aliases:
                found = found | F.contains(padded, F.lit(" " + a))
            chain = F.when(found, F.lit(brand)).otherwise(chain)
        return chain

    return let(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), first)


def canonical_brand(text: Column) -> Column:
    return F.coalesce(F.nullif(known_brand(text), F.lit("")), F.trim(F.coalesce(text, F.lit(""))))


def brand_family(text: Column) -> Column:
    brand = canonical_brand(text)
    return F.when(brand.isin("Nike", "Jordan"), F.lit("Nike")).otherwise(brand)


def known_family(text: Column) -> Column:
    """Brand family in lower case, and empty for a brand that is not known: such a string is no evidence of anything."""
    return let(known_brand(text), lambda brand: F.lower(F.when(brand.isin("Nike", "Jordan"), F.lit("Nike")).otherwise(brand)))


def size_category(text: Column) -> Column:

    def of(low: Column) -> Column:
        chain = F.when(gender_word(low) != "unknown", F.lit("adult")).otherwise(F.lit("unknown"))
        for category, pattern in reversed(CATEGORIES):
            chain = F.when(low.rlike(pattern), F.lit(category)).otherwise(chain)
        return chain

    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def gender_word(low: Column) -> Column:
    chain = F.lit("unknown")
    for gender, pattern in reversed(GENDERS):
        chain = F.when(low.rlike(pattern), F.lit(gender)).otherwise(chain)
    return chain


def gender(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(size_category(text).isin("td", "ps", "gs"), F.lit("kids")).otherwise(gender_word(low))


def compatible(a: Column, b: Column, *unknown: str) -> Column:
    """Null where either side is empty or unknown, else equality."""
    blank = ["", "unknown", *unknown]
    return F.when(F.coalesce(a, F.lit("")).isin(blank) | F.coalesce(b, F.lit("")).isin(blank), F.lit(None)).otherwise(a == b)


def colour_tokens(text: Column) -> Column:
    """Ordered distinct colours and nicknames by their canonical names; a known phrase is one token, and what touches it is part of it."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "&| and ", "/"), r"[()\[\]']", " ")
    gap = r"\s/,\-–|"
    phrase = rf"[^{gap}]*?(?<![a-z])(?:{'|'.join(PHRASES)})(?![a-z])[^{gap}]*"
    names = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    words = F.transform(F.regexp_extract_all(low, F.lit(rf"{phrase}|[^{gap}]+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(names, w), w))
    return F.array_distinct(F.filter(words, lambda w: w.isin(KNOWN)))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def nickname_score(nickname: Column, name: Column) -> Column:
    """0.95 where both have the same words; 0.85 (several words) or 0.5 (one) where the nickname's are some of the name's; else null."""
    return let(name_words(nickname), lambda x: let(name_words(name), lambda y: words_score(x, y)))


def name_words(text: Column) -> Column:
    """Distinct words of two letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 2))


def words_score(x: Column, y: Column) -> Column:
    """nickname_score of the words of a nickname and a name."""
    inside = (F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0)
    return F.when(inside & (F.size(x) == F.size(y)), F.lit(0.95)).when(inside & (F.size(x) > 1), F.lit(0.85)).when(inside, F.lit(0.5))


def token_similarity(x: Column, y: Column) -> Column:
    """The lesser of two Jaccard measures of colour tokens, those of colours (times 0.7 where the leading primaries differ) and of
    nicknames; null where the two have neither kind in common to compare."""
    colours = lambda t: F.filter(t, lambda w: ~w.isin(NICKNAMES))
    nicknames = lambda t: F.filter(t, lambda w: w.isin(NICKNAMES))
    lead = lambda t: F.get(F.filter(F.split(F.array_join(t, " "), " "), lambda w: w.isin(PRIMARIES)), F.lit(0))
    both = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0)
    turned = lambda a, b: F.when(F.coalesce(lead(a) != lead(b), F.lit(False)), F.lit(0.7)).otherwise(F.lit(1.0))
    by_colour = let(colours(x), lambda a: let(colours(y), lambda b: F.when(both(a, b), jaccard(a, b) * turned(a, b))))
    by_name = let(nicknames(x), lambda a: let(nicknames(y), lambda b: F.when(both(a, b), jaccard(a, b))))
    return F.least(by_colour, by_name)


#: Colour tokens by their bit: a word of bits for each 62 colours, nicknames in a word of their own.
BITS = [[w for w in KNOWN if w not in NICKNAMES][i : i + 62] for i in range(0, len(KNOWN) - len(set(NICKNAMES)), 62)] + [NICKNAMES]


def marks(tokens: Column) -> Column:
    """struct(w0, w1, ..., colours, nicknames, lead) of distinct colour tokens: sets of bits, their sizes, and the leading primary. Made once for each text, so that pairs cost little."""
    zero = F.lit(0).cast("long")

    def word(names: list[str]) -> Column:
        bit = F.create_map(*[x for b, w in enumerate(names) for x in (F.lit(w), F.lit(1 << b).cast("long"))])
        return F.aggregate(tokens, zero, lambda a, w: a.bitwiseOR(F.coalesce(F.try_element_at(bit, w), zero)))

    words = [word(names).alias(f"w{i}") for i, names in enumerate(BITS)]
    lead = F.get(F.filter(F.split(F.array_join(F.filter(tokens, lambda w: ~w.isin(NICKNAMES)), " "), " "), lambda w: w.isin(PRIMARIES)), F.lit(0))
    named = F.size(F.filter(tokens, lambda w: w.isin(NICKNAMES)))
    return F.when(tokens.isNotNull(), F.struct(*words, (F.size(tokens) - named).alias("colours"), named.alias("nicknames"), lead.alias("lead")))


def with_marks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the marks of text columns (name: column), null as empty; every distinct text is looked at once, into a written table."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = df.select(F.explode(F.array_distinct(F.array(*map(plain, columns.values())))).alias("txt")).distinct()
    seen = written(texts.withColumn("marks", marks(colour_tokens(F.col("txt")))), "marks")
    for name, c in columns.items():
        key = f"{name}_of"
        # Every text has its marks, so a left join finds the same and cannot send the rows themselves to all tasks.
        df = df.withColumn(key, plain(c)).join(seen.select(F.col("txt").alias(key), F.col("marks").alias(name)), key, "left").drop(key)
    return df


def mark_similarity(x: Column, y: Column) -> Column:
    """token_similarity of the tokens of two marks."""
    *colours, nickname = [f"w{i}" for i in range(len(BITS))]

    def alike(words: list[str], n: str) -> Column:
        shared = sum((F.bit_count(x[w].bitwiseAND(y[w])) for w in words[1:]), F.bit_count(x[words[0]].bitwiseAND(y[words[0]])))
        return F.when((x[n] > 0) & (y[n] > 0), F.try_divide(shared.cast("double"), x[n] + y[n] - shared))

    turned = F.when(F.coalesce(x["lead"] != y["lead"], F.lit(False)), F.lit(0.7)).otherwise(F.lit(1.0))
    return F.least(alike(colours, "colours") * turned, alike([nickname], "nicknames"))


def colour_similarity(a: Column, b: Column) -> Column:
    """token_similarity of two texts."""
    return let(colour_tokens(a), lambda x: let(colour_tokens(b), lambda y: token_similarity(x, y)))
