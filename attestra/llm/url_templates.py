"""URL filters: host rules first, then a path-template tree whose templates are judged by smoothed labelled purity.

Rules name a host and a path; a rule fits its host, all subdomains and paths that start with its own, and the longest rule wins.
The rules are a parameter of bounded size, so they compile into one expression.

Urls without a rule are judged by the tree. A node is (host, template of the path so far). Level by level, to the end of the
longest path, segments that look variable (numbers, hashes) become wildcards, and sibling branches that are statistically alike are
merged. A branch stands out if its labelled rate differs from its node's by more standard errors than chance gives to one of so
many siblings; all others are one pool. The branches that stand out, pooled by thousandths of their rates, and that pool are
sorted by rate and agglomerated while neighbours pass a pooled two-proportion test. A group of one branch keeps its segment, the
group with the pool (without one, that of the smallest rate) is ``*``, others are ``*1``, ``*2`` and so on, by rate.
A path that is alone at its node needs no more levels. Each url then has one template;
templates are rejected when their labelled bad share, smoothed towards the share of the level above, reaches `reject`.
Counting is by groupBy on nodes with partial sums, so a host with a third of all urls is a few counts per task.

Defined cases: null urls and urls without ``://`` have empty host and path and are judged like others; null ids are never
labelled; repeated rows are counted and judged one by one; a share that ties with `reject` blocks; empty tables give empty results;
a very long path is followed to its end, one level at a time as long as it has siblings; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, materialize

#: Rates that differ by less than one of so many parts are pooled before they are compared.
BINS = 1000
#: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url: text after the first ``://``, cut at its delimiters."""
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    there = F.contains(url, F.lit("://"))
    host = F.when(there, F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, UPPER.lower())).otherwise("")
    path = F.when(there, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def apply_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule; of rules of one length the last in order of text."""
    host, path = F.col("host"), F.col("path")
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        chain = F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def shape(segment: Column) -> Column:
    """Variable-looking segments as their wildcard; the extension stays."""
    stem, ext = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 2)
    mark = (
        F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(stem.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{id}"))
        .when(stem.rlike(r"[0-9]{3,}"), F.regexp_replace(stem, r"[0-9]+", "{n}"))
        .otherwise(stem)
    )
    return F.concat(mark, ext)


def shaped(path: Column) -> Column:
    """The segments of a path, variable ones as wildcards."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def clusters(items: Column, z: float) -> Column:
    """array<struct(n, b, segs, rest, top)>: sorted items (key, n, b, segs, rest), neighbours pooled while they are alike.

    Two pools are alike while their shares of bad labels differ by no more than z standard errors of the pooled share, or where one
    has no labels.
    """
    kind = "array<struct<n:bigint,b:bigint,segs:bigint,rest:boolean,top:double>>"

    def add(done: Column, x: Column) -> Column:
        last, own = F.element_at(done, -1), F.struct(x["n"].alias("n"), x["b"].alias("b"), x["segs"].alias("segs"), x["rest"].alias("rest"), x["key"].alias("top"))
        n, of = last["n"] + x["n"], F.try_divide
        share = of(last["b"] + x["b"], n)
        error = F.sqrt(share * (1 - share) * (of(F.lit(1), last["n"]) + of(F.lit(1), x["n"])))
        alike = F.coalesce(F.abs(of(last["b"], last["n"]) - of(x["b"], x["n"])) <= z * error, F.lit(True))
        both = F.struct(n.alias("n"), (last["b"] + x["b"]).alias("b"), (last["segs"] + x["segs"]).alias("segs"), (last["rest"] | x["rest"]).alias("rest"), x["key"].alias("top"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))
        return F.when(F.size(done) == 0, F.array(own)).when(alike, joined).otherwise(F.concat(done, F.array(own))).cast(kind)

    return F.aggregate(items, F.array().cast(kind), add)


def grow(rows: DataFrame, z: float) -> DataFrame:
    """rows (host, segs, n_labels, n_bad) as (host, segs, n_labels, n_bad, template), one row for each host and shaped path.

    One pass of counts, judgement and join for each level, over distinct shaped paths and not urls.
    """
    tree = rows.groupBy("host", "segs").agg(F.sum("n_labels").alias("n_labels"), F.sum("n_bad").alias("n_bad"))
    tree = materialize(tree.withColumns({"template": F.lit(""), "open": F.size("segs") > 0}), "url-tree")
    ended, level, c = tree.where("NOT open"), 0, F.col
    here = tree.where("open")
    while not here.isEmpty():
        here = here.withColumn("seg", F.get("segs", F.lit(level)))
        branch = here.groupBy("host", "template", "seg").agg(F.count(F.lit(1)).alias("paths"), F.sum("n_labels").alias("n"), F.sum("n_bad").alias("b"))
        node = branch.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("paths").alias("all_paths"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
        rate = (c("all_b") + 0.5) / (c("all_n") + 1)
        judged = branch.join(node, ["host", "template"]).withColumn("rate", rate).withColumn("own", (c("b") + c("rate")) / (c("n") + 1))
        # A branch stands out by more errors of chance the more siblings it has; the others are one pool.
        error = F.sqrt(F.greatest(c("rate") * (1 - c("rate")), c("own") * (1 - c("own"))) / (c("n") + 1))
        apart = F.abs(c("own") - c("rate")) > F.sqrt(z * z + 2 * F.log(c("children"))) * error
        judged = judged.select("host", "template", "seg", "n", "b", "rate", (c("all_paths") == 1).alias("alone"), F.when(apart, F.floor(c("own") * BINS)).alias("bin"))
        pools = judged.groupBy("host", "template", "bin").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("segs"), F.max("rate").alias("rate"))
        key = F.coalesce(c("bin").cast("double"), (c("b") + c("rate")) / (c("n") + 1) * BINS)
        item = F.struct(key.alias("key"), c("bin").isNull().alias("rest"), "n", "b", "segs")
        # At most BINS + 2 items a node, whatever the number of branches.
        sides = pools.groupBy("host", "template").agg(F.array_sort(F.collect_list(item)).alias("items"))
        sides = sides.select("host", "template", F.get(F.filter("items", lambda i: i["rest"]), F.lit(0))["key"].alias("rest_key"), clusters(c("items"), z).alias("groups"))
        place = F.size(F.filter("groups", lambda g: g["top"] < F.coalesce(c("bin").cast("double"), c("rest_key"))))
        group = F.get("groups", place)
        main = F.when(F.exists("groups", lambda g: g["rest"]), group["rest"]).otherwise(place == 0)
        step = F.when(group["segs"] == 1, c("seg")).when(main, F.lit("*")).otherwise(F.concat(F.lit("*"), place.cast("string")))
        steps = judged.join(sides, ["host", "template"]).select("host", "template", "seg", step.alias("step"), "alone")
        # What follows on a path that is alone has no siblings, so nothing merges there.
        tail = F.when(c("alone"), F.concat_ws("/", F.slice("segs", F.lit(level + 1), F.size("segs")))).otherwise(c("step"))
        further = ~c("alone") & (F.size("segs") > level + 1)
        tree = materialize(
            here.join(steps, ["host", "template", "seg"]).select("host", "segs", "n_labels", "n_bad", F.concat("template", F.lit("/"), tail).alias("template"), further.alias("open")),
            "url-tree",
        )
        ended, here, level = ended.unionByName(tree.where("NOT open")), tree.where("open"), level + 1
        if level % 16 == 0:  # the plan stays short on the deepest paths
            ended = materialize(ended, "url-ended")
    return ended.select("host", "segs", "n_labels", "n_bad", "template")


def url_filter(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    z: float = 2.0,
    prior: float = 4.0,
    reject: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share. labels: (id, bad) with bad a boolean, at most one row per id counted as true if any is."""
    urls = pages.select(F.monotonically_increasing_id().alias("row"), pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"))
    host, path = parts(F.col("url"))
    marked = labels.select(labels.columns[0], labels.columns[1]).toDF("page_id", "bad").where("page_id IS NOT NULL AND bad IS NOT NULL")
    marked = marked.groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    rows = urls.select("row", "page_id", host.alias("host"), path.alias("path")).join(marked, "page_id", "left")
    rows = rows.withColumns({"n_labels": F.col("bad").isNotNull().cast("long"), "n_bad": F.coalesce(F.col("bad").cast("long"), F.lit(0)), "segs": shaped(F.col("path"))})
    rows = materialize(rows.drop("bad"), "urls")
    total = rows.agg(((F.sum("n_bad") + 0.5) / (F.sum("n_labels") + 1)).alias("share")).first()["share"]
    share = F.lit(float(total if total is not None else 0.5))
    # Templates are judged on the tree; urls meet it once, by host and shaped path.
    tree = grow(rows, z)
    by_host = tree.groupBy("host").agg(F.sum("n_labels").alias("host_labels"), F.sum("n_bad").alias("host_bad"))
    stats = tree.groupBy("host", "template").agg(F.sum("n_labels").alias("labels"), F.sum("n_bad").alias("bad")).join(by_host, "host")
    of_host = (F.col("host_bad") + prior * share) / (F.col("host_labels") + prior)
    purity = (F.col("bad") + prior * of_host) / (F.col("labels") + prior)
    known = tree.select("host", "segs", "template").join(stats.select("host", "template", purity.alias("bad_share")), ["host", "template"])
    judged = rows.join(materialize(known, "url-verdicts"), ["host", "segs"])
    judged = judged.withColumn("hit", apply_rules(judged, rules if rules is not None else RULES))
    verdict = F.coalesce("hit.verdict", F.when(F.col("bad_share") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "template", "bad_share")
