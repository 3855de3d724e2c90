"""Secret scans: spans by pattern, and corpus-wide ownership frequency of every candidate value.

A scan finds the base kinds in each whole text and wider candidates (long opaque tokens). Candidate values are hashed and
counted by distinct owners and repositories over the whole corpus; a value that many owners share is a copied example, one
that stays with few owners and looks random is a live-looking credential, and its span is added as kind ``owned``.

Plan: one scan writes spans without texts; counts are partial sums by (hash, owner, repository), so a value in a third of all
rows reaches the shuffle once per task; the join back is an equi-join that adaptive execution may split.

Defined cases: null or empty texts have no spans; null owners or repositories count as the empty name; repeated rows keep a
row each; ties (spans of one start) are ordered by kind; an empty table gives an empty result; columns other than those named are not
read, and may have any name. A very long text is scanned whole; time follows its length and its number of spans, not their product.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, named, running

SPAN = "array<struct<start:int,end:int,value:string>>"


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind: (pattern, group that holds the value, least length of the value); matches with shorter values are dropped.
KEYWORDS = [*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")]
ASSIGN = "(" + "|".join(KEYWORDS) + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Wider candidates: only the corpus decides whether they are reported.
CANDIDATE = r"[A-Za-z0-9_+/-]{20,}"
OWNED = "owned"
ORDER = [*KINDS, OWNED]


def find(text: Column, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches: texts between matches give the starts."""
    rx = F.lit(pattern)
    zero = F.lit(0)

    def spans(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p["gap"]) + F.length(p["hit"]))
        span = lambda ends: lambda p, i: F.struct((F.get(ends, i) + F.length(p["gap"])).alias("start"), F.get(ends, i + 1).alias("end"), p["value"].alias("value"))
        return F.filter(let(running(lengths, zero, lambda a, x: a + x), lambda ends: F.transform(parts, span(ends))), lambda s: F.length(s["value"]) >= least)

    def matched(hits: Column) -> Column:
        values = F.regexp_extract_all(text, rx, F.lit(group)) if group else hits
        return let(F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value")), spans)

    return let(F.regexp_extract_all(text, rx, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, matched(hits)).otherwise(F.array().cast(SPAN)))


def apart(spans: Column, taken: Column) -> Column:
    """Spans that overlap none of taken: in one order of starts, none taken before ends later and none taken after starts sooner."""
    far = F.lit(2**31 - 1)
    tagged = lambda xs, own: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["value"].alias("value")))

    def clear(every: Column) -> Column:
        ends = F.transform(every, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(0)))
        starts = F.reverse(F.transform(every, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(far)))
        latest, soonest = running(ends, F.lit(0), F.greatest), running(starts, far, F.least)
        free = lambda e, s: lambda x, i: (x["own"] == 1) & (F.get(e, i) <= x["start"]) & (F.get(s, F.size(every) - 1 - i) >= x["end"])
        return let(latest, lambda e: let(soonest, lambda s: F.filter(every, free(e, s))))

    every = F.sort_array(F.concat(tagged(taken, 0), tagged(spans, 1)))
    return F.transform(let(every, clear), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", with_documents: bool = False) -> DataFrame:
    """row, doc_id, owner, repo and the spans of each base kind and of the candidates outside base spans; written, without texts.

    with_documents: the rows' own columns, texts included, are kept in a struct ``document``.
    """
    document = [F.struct(*[named(docs, c) for c in docs.columns]).alias("document")] if with_documents else []
    df = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[owner_col].cast("string"), F.lit("")).alias("owner"),
        F.coalesce(docs[repo_col].cast("string"), F.lit("")).alias("repo"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
        *document,
    )
    kept = ["row", "doc_id", "owner", "repo", *(["document"] if with_documents else [])]
    df = df.select(*kept, *[find(F.col("text"), *rule).alias(kind) for kind, rule in KINDS.items()], find(F.col("text"), CANDIDATE, 0, 20).alias("wide"))
    # A live-looking value mixes letters and digits and repeats few characters; one that a base kind reports already is not added.
    looks = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 10)
    likely = F.filter("wide", lambda s: looks(s["value"]))
    wide = let(likely, lambda w: F.when(F.size(w) > 0, apart(w, F.concat(*[F.col(k) for k in KINDS]))).otherwise(w))
    return materialize(df.withColumn("wide", F.when(F.size("wide") > 0, wide).otherwise(F.col("wide"))), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """hash: n_owners, n_repos, n_rows over the corpus; a repository belongs to its owner, so distinct pairs add up."""
    pairs = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))


def judged_spans(seen: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """row, spans: for rows of scan with any span to report, the base ones and the live-looking candidates in order."""

    def tag(column: str, kind: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))

    tagged = F.concat(*[tag(k if k != OWNED else "wide", i) for i, k in enumerate(ORDER)])
    rows = seen.select("row", "owner", "repo", F.explode(tagged).alias("s")).select("row", "owner", "repo", "s.*")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = rows.join(ownership(rows), "hash").withColumn("live", live).where((F.col("kind") < len(KINDS)) | F.col("live"))
    return judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "hash", "n_owners", "n_repos", "live"))).alias("spans"))


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """One row per document: row, doc_id, the base kinds' spans, spans (struct kind, start, end, hash, n_owners, n_repos, live) of all kinds in order."""
    seen = scan(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col)
    return seen.drop("owner", "repo", "wide").join(judged_spans(seen, max_owners, max_repos), "row", "left")


def span_text(spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    name = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from secret_scan."""
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    count = lambda test: F.coalesce(F.size(F.filter("spans", test)), F.lit(0)).cast("long")
    has = F.col("spans").isNotNull()
    return scanned.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.when(has, span_text(base)).otherwise(F.lit("")), 256).alias("base_sha256"),
        F.when(has, span_text(F.col("spans"))).otherwise(F.lit("")).alias("spans"),
        F.when(has, count(lambda s: s["live"])).otherwise(F.lit(0)).cast("long").alias("n_live"),
        F.when(has, count(lambda s: ~s["live"])).otherwise(F.lit(0)).cast("long").alias("n_copied"),
    )


def cut_out(text: Column, spans: Column, mark: str, block: int = 1024) -> Column:
    """text with each run of overlapping spans (sorted by start) replaced by mark.

    The text is held in blocks, so that what lies between two marks costs its own length and not its place.
    """

    def between(blocks: Column, start: Column, end: Column) -> Column:
        """Characters start to end: the parts that they have of each block they touch."""
        first, last = F.floor(start / block).cast("int"), F.floor((end - 1) / block).cast("int")
        low = lambda i: F.greatest(start - i * block, F.lit(0))
        part = lambda i: F.substring(F.get(blocks, i), low(i) + 1, F.least(end - i * block, F.lit(block)) - low(i))
        return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise(F.lit(""))

    def parts(blocks: Column, ends: Column) -> Column:
        """ends: how far the spans before each one reach. A span that starts inside them has its mark already."""
        held = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(ends, i), F.concat(between(blocks, F.get(ends, i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(held, ""), between(blocks, F.element_at(ends, -1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    reach = running(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)
    return let(blocks, lambda b: let(reach, lambda e: parts(b, e)))


def redact(docs: DataFrame, mark: str = "[secret]", *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """docs with every reported span replaced by mark: base kinds by their patterns, owned values where the corpus judged them live.

    Documents without any span or candidate pass by without a shuffle; the others meet their judged spans by row number, so repeated
    or null ids do no harm. A column n_chars, where there is one, follows the new text.
    """
    seen = scan(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col, with_documents=True)
    quiet = F.lit(True)
    for k in (*KINDS, "wide"):
        quiet = quiet & (F.size(k) == 0)
    loud = seen.where(~quiet).select("row", "document").join(judged_spans(seen, max_owners, max_repos), "row", "left")
    hit, own = F.col("spans").isNotNull(), lambda c: F.col("document")[c]
    changed = {text_col: F.when(hit, cut_out(F.coalesce(own(text_col), F.lit("")), F.col("spans"), mark)).otherwise(own(text_col))}
    loud = loud.select("document", "spans", changed[text_col].alias("clean"))
    out = {text_col: F.col("clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(hit, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return seen.where(quiet).select("document.*").union(loud.select(*[out.get(c, own(c)).alias(c) for c in docs.columns]))
