"""Document fingerprints by Order MinHash: minimal occurrence-numbered k-mers, kept in text order, hashed as tuples.

A text's k-mers (k words each) are numbered by occurrence, so that repeats count; each gets a hash of its words and its number.
Hashes are dealt to `BUCKETS` buckets by their low bits; in each bucket the `PICKS` least are put back in text order and hashed as
one tuple. Two texts agree in a bucket when they share its minimal k-mers in the same order, so the share of agreeing buckets
falls with edit distance and not only with overlap. To save sorting, the minima of a long text are first looked for below a bound
that leaves `SPARE` candidates per pick on average; where a bucket has fewer than `PICKS` of them, that text's minima are taken
again from all its k-mers. A fingerprint thus holds the minima over all k-mers, whatever the bound.

`neighbours` finds each text's successor in an order over the whole table without a global window: ids are cut into ranges by
quantiles, null and repeated ids by the hash of their texts; texts are shuffled once by range, and each range also receives the first
text of the next one.

Defined cases: null texts count as empty, and empty texts have a fingerprint of empty buckets, alike to itself only (likeness 1
between two such); texts shorter than k words are one k-mer; among equal ids the order is by hash of the text, null ids come
last; repeated rows give a row each; an empty table gives an empty result; a very long text is fingerprinted whole, in memory of
some times its length; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, let, materialize, texts

K = 3
BUCKETS = 32
PICKS = 2
SPARE = 3
#: Text behind one range of ids, and the number of quantiles that cut them; beyond it ranges are cut evenly once more.
RANGE_BYTES = 8 << 20
QUANTILES = 1000
#: About so many ranges at most; beyond, a range is more text.
MOST_RANGES = 1 << 16
#: Ranges that one row stands for where ranges are put in order.
STRETCH = 1024
EMPTY = 0


def signature(text: Column, k: int = K, buckets: int = BUCKETS, picks: int = PICKS) -> Column:
    """array<int> of bucket hashes; 0 stands for an empty bucket."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n_kmers = lambda hs: F.greatest(F.size(hs) - (k - 1), F.lit(1))
    # Each word is hashed once; a k-mer's hash is that of its words' hashes (a place beyond the last word adds nothing).
    kmer = lambda hs, i: F.xxhash64(*[F.get(hs, i + j) for j in range(k)])
    kmers = lambda hs: F.transform(F.sequence(F.lit(0), n_kmers(hs) - 1), lambda i: F.struct(kmer(hs, i).alias("h"), i.alias("i")))

    def numbered(s: Column) -> Column:
        """Every k-mer with its occurrence in its hash, from the k-mers sorted by hash and place."""
        again = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
        number = lambda x, occ: F.struct(F.xxhash64(x["h"], occ).alias("v"), x["i"].alias("i"))
        firsts = F.transform(F.filter(s, lambda x, j: ~again(x, j)), lambda x: number(x, F.lit(0)))

        def later(r: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda j: F.coalesce(F.get(r, j - 1)["h"] != F.get(r, j)["h"], F.lit(True)))
            run = lambda e, j, m: F.slice(r, j + 1, F.coalesce(F.get(e, m + 1), F.size(r)) - j)
            return let(heads, lambda e: F.flatten(F.transform(e, lambda j, m: F.transform(run(e, j, m), lambda x, o: number(x, o + 1)))))

        # Later occurrences are few in most texts.
        return let(F.filter(s, again), lambda r: F.when(F.size(r) > 0, F.concat(firsts, later(r))).otherwise(firsts))

    def dealt(c: Column) -> Column:
        """Candidates sorted by bucket and hash: a bucket's picks are the places that follow its first."""
        return F.sort_array(F.transform(c, lambda x: F.struct(F.pmod(x["v"], F.lit(buckets)).cast("int").alias("b"), x["v"].alias("v"), x["i"].alias("i"))))

    def first_of(s: Column) -> Column:
        return F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(F.get(s, j - 1)["b"] != F.get(s, j)["b"], F.lit(True)))).otherwise(F.array().cast("array<int>"))

    def candidates(c: Column) -> Column:
        """Those below the bound if they give every bucket its picks, else all."""
        n = F.size(c)
        bound = (F.lit(-(2.0**63)) + F.lit(2.0**64 * buckets * picks * SPARE) / n).cast("long")
        enough = lambda s: F.size(F.filter(first_of(s), lambda j: F.get(s, j + (picks - 1))["b"] == F.get(s, j)["b"])) == buckets
        few = let(bound, lambda limit: dealt(F.filter(c, lambda x: x["v"] < limit)))
        return F.when(n <= buckets * picks * SPARE, dealt(c)).otherwise(let(few, lambda s: F.when(enough(s), s).otherwise(dealt(c))))

    def picked(s: Column) -> Column:
        def tuple_at(j: Column) -> Column:
            own = F.filter(F.slice(s, j + 1, F.lit(picks)), lambda x: x["b"] == F.get(s, j)["b"])
            ordered = F.transform(F.sort_array(F.transform(own, lambda x: F.struct(x["i"], x["v"]))), lambda x: x["v"])
            folded = F.xxhash64(ordered).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
            return F.struct(F.get(s, j)["b"].alias("b"), F.greatest(folded, F.lit(1)).alias("t"))

        filled = F.transform(first_of(s), tuple_at)
        return let(filled, lambda f: F.aggregate(f, F.array_repeat(F.lit(EMPTY), 0), lambda acc, x: F.concat(acc, F.array_repeat(F.lit(EMPTY), x["b"] - F.size(acc)), F.array(x["t"]))))

    def padded(f: Column) -> Column:
        return let(f, lambda x: F.concat(x, F.array_repeat(F.lit(EMPTY), F.lit(buckets) - F.size(x))))

    some = lambda hs: let(F.sort_array(kmers(hs)), lambda s: let(numbered(s), lambda c: let(candidates(c), lambda d: padded(picked(d)))))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda hs: F.when(F.size(hs) > 0, some(hs)).otherwise(F.array_repeat(F.lit(EMPTY), buckets)))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing buckets among those that either text fills; 1 for two empty ones."""
    filled = F.zip_with(a, b, lambda x, y: ((x != EMPTY) | (y != EMPTY)).cast("int"))
    agree = F.zip_with(a, b, lambda x, y: ((x == y) & (x != EMPTY)).cast("int"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(F.try_divide(total(agree).cast("double"), total(filled)), F.lit(1.0))


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits per bucket."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def id_range(bounds: list[int], parts: int, null_parts: int = 1) -> Column:
    """Number of the row's range by descending id, then text_hash: quantile cell, then `parts` even cuts inside it. Null ids have the last
    `null_parts` ranges.

    An id that is several quantiles has as many ranges of its own, times parts; these, and those of null ids, are cut by the hash of the text.
    """
    i = F.col("doc_id")
    spread = F.col("text_hash").cast("double") / F.lit(2.0**64) + 0.5
    nulls = lambda first: F.lit(first) + F.greatest(F.lit(0), F.least(F.floor(spread * null_parts), F.lit(null_parts - 1)))
    if not bounds:
        return F.when(i.isNull(), nulls(1)).otherwise(F.lit(0)).cast("long")
    times = Counter(bounds)
    most = max(times.values()) * parts
    ordered = sorted(times, reverse=True)
    edges = F.array(*[F.lit(b).cast("long") for b in ordered])
    shares = F.array(*[F.lit(times[b] * parts if times[b] > 1 else 0) for b in ordered])
    cell = F.size(F.filter(edges, lambda b: b >= i))
    high, low = F.get(edges, cell - 1).cast("double"), F.get(edges, cell).cast("double")
    within = lambda share, n: F.greatest(F.lit(0), F.least(F.coalesce(F.floor(share * n), F.lit(0)), n - 1))
    even = most + within((high - i.cast("double")) / F.greatest(high - low, F.lit(1.0)), F.lit(parts))
    own = F.coalesce(F.when(F.get(edges, cell - 1) == i, F.get(shares, cell - 1)), F.lit(0))
    among = within(spread, own)
    number = cell * (most + parts) + F.when(own > 0, among).otherwise(even)
    return F.when(i.isNull(), nulls((len(ordered) + 1) * (most + parts))).otherwise(number).cast("long")


def neighbours(df: DataFrame, extend: Callable[[DataFrame], DataFrame], *columns: str) -> DataFrame:
    """extend(df) of df (doc_id, text, text_hash) with next_<column> of the row that follows by descending doc_id; the first follows the last.

    extend adds columns row by row; it works on every row once, and on the first row of each range once more.
    """
    size = df.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text"))).alias("nulls")).first()
    most = max(RANGE_BYTES, (size["bytes"] or 0) // MOST_RANGES)
    of = lambda n: max(1, int(n or 0) // most)
    ranges, null_parts = of(size["bytes"]), of(size["nulls"])
    cuts = min(ranges - 1, QUANTILES)
    bounds = df.agg(F.percentile_approx("doc_id", [(j + 1) / (cuts + 1) for j in range(cuts)], 10 * (cuts + 1)).alias("q")).first()["q"] if cuts else None
    number = id_range(bounds or [], -(-ranges // (cuts + 1)), null_parts)
    key = F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)).alias("key")
    # One row per range: its first row's id and hash, and the range before it, round the end.
    firsts = df.select(number.alias("range"), F.struct(key, "text_hash").alias("first")).groupBy("range").agg(F.min("first").alias("first"))
    firsts = materialize(firsts.withColumn("stretch", F.floor(F.col("range") / STRETCH)), "ranges")
    last = firsts.agg(F.max("range").alias("last")).first()["last"]
    # The one window without a key has a row for each stretch of ranges that is not empty.
    ends = firsts.groupBy("stretch").agg(F.max("range").alias("end"))
    ends = ends.select("stretch", F.coalesce(F.lag("end").over(Window.orderBy("stretch")), F.lit(last).cast("long")).alias("before"))
    inside = Window.partitionBy("stretch").orderBy("range")
    before = firsts.join(ends, "stretch").select(F.coalesce(F.lag("range").over(inside), F.col("before")).alias("into"), F.col("first.key").alias("key"), F.col("first.text_hash").alias("text_hash"))
    before = materialize(before, "ranges-before")
    # Guests are the first rows of the next ranges, one each: equal rows are told apart by nothing, and any of them will do. At most some
    # MOST_RANGES rows are broadcast.
    first = F.struct(*df.columns)
    guests = df.withColumn("key", key).join(F.broadcast(before), ["key", "text_hash"]).groupBy("into").agg(F.first(first).alias("row")).select(F.col("into").alias("range"), "row.*")
    dealt = extend(df).withColumns({"range": number, "guest": F.lit(False)}).unionByName(extend(guests).withColumn("guest", F.lit(True)))
    w = Window.partitionBy("range").orderBy("guest", F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)), "text_hash")
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return out.where(~F.col("guest")).drop("range", "guest")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    df = neighbours(texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")), lambda rows: rows.withColumn("own", signature(F.col("text"), k)), "text", "own")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    df = df.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    df = df.select("doc_id", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("edited"), k).alias("changed"))
    return df.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
