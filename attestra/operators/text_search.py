"""Text search over a catalogue: an inverted index of tokens with document frequencies, and the best hits of a set of queries.

A token's impact is its inverse document frequency in thousandths, a whole number, so that scores are exact sums. Products of one set
of tokens are one signature, queries of one set of known tokens one question: repeated titles and queries are searched once.

Queries look tokens up in the order of impact. As `k` products hold the token of the greatest impact that so many hold, the k-th
score is that impact at least; the least tokens, as long as their impacts together stay below it, bring no hit by themselves and are
not looked up, though they count in the score. So common words are seldom joined. Posting lists are dealt into chunks, and a hit is
made for one token only, the first of its query's that it holds.

Defined cases: null and empty texts, and queries of unknown words only, have no hits; a null product id is not listed; a repeated id is one
product for each of its texts; ties go to the product of fewer tokens, then to the smaller id; empty tables give no hits; texts are read
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import growing, written

#: Signatures of a chunk of a posting list.
CHUNK = 10_000


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")))


class Index:
    """Written tables of a catalogue (product_id, text): signatures, their first k products, tokens with impacts, postings in chunks."""

    def __init__(self, products: DataFrame, *, k: int = 10, chunk: int = CHUNK):
        self.k, c = k, F.col
        # Written, so that texts are cut once, in the tasks that products are dealt to, and not by a filter where they are read.
        rows = written(products.where(c("product_id").isNotNull()).select("product_id", tokens(c("text")).alias("words")).distinct(), "search-rows").where(F.size("words") > 0)
        rows = rows.withColumn("sid", F.md5(F.array_join("words", " ")))
        place = F.row_number().over(Window.partitionBy("sid").orderBy("product_id"))
        self.first = written(rows.select("sid", "product_id", place.alias("place")).where(c("place") <= k).drop("place"), "search-first")
        signatures = written(rows.groupBy("sid").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("product_id").alias("least")), "search-signatures")
        single = signatures.select("sid", "words", "n", "least", F.explode("words").alias("token"))
        total = signatures.agg(F.sum("n").alias("total"))
        counts = single.groupBy("token").agg(F.sum("n").alias("df"), F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
        impact = F.round(1000 * F.log(1 + c("total") / c("df"))).cast("long")
        self.tokens = written(counts.join(F.broadcast(total), F.lit(True)).select("token", "df", "chunks", impact.alias("impact")), "search-tokens")
        dealt = F.pmod(F.xxhash64("sid"), c("chunks")).cast("int").alias("chunk")
        self.postings = written(single.join(self.tokens.select("token", "chunks"), "token").select("token", dealt, "sid", "words", "least"), "search-postings")

    def ask(self, asks: DataFrame) -> DataFrame:
        """set, terms: the distinct sets of words that are asked for, with their known tokens by impact, the greatest first."""
        sets = asks.select(tokens(F.col("text")).alias("words")).distinct()
        single = sets.select(F.array_join("words", " ").alias("set"), F.explode("words").alias("token")).join(self.tokens, "token")
        term = F.struct((-F.col("impact")).alias("order"), "token", "impact", "df", "chunks")
        return single.groupBy("set").agg(F.array_sort(F.collect_list(term)).alias("terms"))

    def search(self, asks: DataFrame) -> DataFrame:
        """The columns of asks but text, with product_id, score, rank: the k best products for every text."""
        c = F.col
        asked = written(self.ask(asks).withColumn("question", F.array_join(F.transform("terms", lambda t: t["token"]), " ")), "search-asked")
        bar = F.coalesce(F.array_max(F.transform(F.filter("terms", lambda t: t["df"] >= self.k), lambda t: t["impact"])), F.lit(0))
        rest = lambda i: F.aggregate(F.slice("terms", i + 2, F.size("terms")), F.lit(0).cast("long"), lambda a, t: a + t["impact"])
        # The first place behind which the rest stays below the bar.
        needed = F.array_min(F.filter(F.transform("terms", lambda t, i: F.when(rest(i) < c("bar"), i + 1).otherwise(F.size("terms"))), lambda n: n.isNotNull()))
        questions = asked.select("question", "terms").distinct().withColumn("bar", bar)
        looked = questions.select("question", "terms", F.posexplode(F.slice("terms", F.lit(1), needed)).alias("i", "t"))
        looked = looked.select("question", "terms", "i", c("t.token").alias("token"), F.explode(F.sequence(F.lit(0), c("t.chunks") - 1)).alias("chunk"))
        met = looked.join(self.postings, ["token", "chunk"])
        once = ~F.exists(F.slice("terms", F.lit(1), c("i")), lambda t: F.array_contains("words", t["token"]))
        score = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.when(F.array_contains("words", t["token"]), t["impact"]).otherwise(F.lit(0)))
        scored = met.where(once).select("question", "sid", score.alias("score"), F.size("words").alias("size"), "least")
        best = lambda *by: F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "size", *by))
        near = scored.withColumn("rank", best("least")).where(c("rank") <= self.k).drop("rank", "least")
        hits = near.join(self.first, "sid").withColumn("rank", best("product_id")).where(c("rank") <= self.k)
        # Hits are a row for each set and place, fewer than those of all asks; written, so that no plan holds both the search and the asks.
        hits = written(hits.select("question", "product_id", "score", "rank"), "search-hits")
        found = asked.select("set", "question").join(hits, "question").drop("question")
        return growing(asks.withColumn("set", F.array_join(tokens(c("text")), " "))).join(found, "set").drop("set", "text")
