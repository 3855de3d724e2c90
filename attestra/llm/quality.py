"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over the whole text and every rule a comparison from the table, so one pass over the
scan decides each document without user functions, joins or shuffles.

Defined cases: a null or empty text has no words, all measures 0 and fails; a null id stays null; repeated rows are judged alike,
one row each, and no rule compares rows, so there are no ties; an empty table gives an empty result; extra columns are not read
by the rules and may have any name, dots included. A very long text is measured whole, in memory of some times its length. Windows
are compared by 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, named

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is that for with as was by on are this be at or an it from he which have "
    "le la les de des du et en un une que qui dans pour par au aux est sur avec "
    "der die das und von zu den dem ein eine ist im mit für auf nicht sich als auch "
    "el los las del que por con una su para se lo como al no"
).split()

#: measure: (least, most); None leaves that side open. A document is kept when every measure stays inside.
THRESHOLDS: dict[str, tuple[float | None, float | None]] = {
    "n_words": (20, None),
    "repeat_percent": (None, 30.0),
    "mean_word_chars": (2.0, 15.0),
    "symbols_per_word": (None, 0.3),
    "shouts_per_word": (None, 0.4),
    "dup_line_ratio": (None, 0.5),
    "stop_word_ratio": (0.01, None),
}


def _repeated(words: Column, hashes: Column, w: int) -> Column:
    """Words inside windows whose hash occurs twice: sort (hash, start), keep neighbours that agree, add up their cover."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        n = F.size(s)
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        hit = lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), hit), lambda k: F.get(s, k)["i"]))

    def cover(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, F.lit(1), F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(w)).cast("long"))
        return F.aggregate(gaps, F.lit(w).cast("long"), lambda total, g: total + g)

    return let(ordered, lambda s: let(starts(s), cover))


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stop_words: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """The documents' own columns as struct ``document`` beside their measures. One row per document with the counts and ratios the rules read: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and ratios."""
    stop = list(stop_words or STOP_WORDS)
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.struct(*[named(docs, c) for c in docs.columns]).alias("document"))
    df = df.select(
        "doc_id", "document",
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_shouts"),
        lines.alias("lines"),
    )
    n, words = F.size("words"), F.col("words")
    df = df.select(
        "doc_id", "document", "word_chars", "n_symbols", "n_shouts",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(stop))).cast("long").alias("n_stop_words"),
        F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))).alias("hashes"),
        words,
    )
    h = F.col("hashes")
    df = df.withColumn("n_repeat_words", F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated(words, h, window)).otherwise(F.lit(0)).cast("long"))
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_words")), F.lit(0.0))
    # A filter above must not be pushed below: it would compute the words anew for each measure it names. A field that
    # depends on the row's number holds it here.
    measured = F.when(F.monotonically_increasing_id() >= 0, F.col("n_words")).otherwise(F.lit(0)).alias("n_words")
    return df.select(
        "doc_id", "document", measured, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbols_per_word"),
        per_word("n_shouts").alias("shouts_per_word"),
        per_word("n_stop_words").alias("stop_word_ratio"),
        F.coalesce(F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines")), F.lit(0.0)).alias("dup_line_ratio"),
    )


def compile_rules(thresholds: dict[str, tuple[float | None, float | None]]) -> Column:
    """The table as one boolean expression: repeat_percent is compared without division so that it is exact."""
    ok = F.lit(True)
    for name, (low, high) in thresholds.items():
        if name == "repeat_percent":
            value, unit = 100 * F.col("n_repeat_words"), F.col("n_words")
        else:
            value, unit = F.col(name), F.lit(1)
        if low is not None:
            ok = ok & (value >= F.lit(low) * unit)
        if high is not None:
            ok = ok & (value <= F.lit(high) * unit)
    return ok


def quality_rules(docs: DataFrame, thresholds: dict[str, tuple[float | None, float | None]] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of each document, base_failed (too short, or over 30 % repeated) and kept (every rule of the table holds)."""
    m = measure(docs, id_col=id_col, text_col=text_col)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.withColumns({"base_failed": base, "kept": ~base & compile_rules(thresholds or THRESHOLDS)})


def quality_filter(docs: DataFrame, thresholds: dict[str, tuple[float | None, float | None]] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their own columns; no join and no shuffle."""
    return quality_rules(docs, thresholds, id_col=id_col, text_col=text_col).where("kept").select("document.*")
