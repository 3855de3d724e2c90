import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from attestra.llm import quality


def brute(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    cover = {k for i in range(len(ws) - 7) if c[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def check(spark, texts):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, words string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, b = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, t
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (r.base_failed and r.kept)


def test_fixed_cases(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    check(spark, [None, "", " \t\n", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "l1\nl1\n\n \nl2\nl1", "é#*😀$ %&|<>", long, "a b c d e f g h i\n" * 5])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t#é ", max_size=120), min_size=1, max_size=20))
def test_random_texts(spark, texts):
    check(spark, texts)


def test_prose_is_kept_and_empty_table(spark):
    text = "The report of the committee was sent to the members and it is on the table for all of them to read at once. " * 1 + "They agreed that the plan is good."
    schema = "doc_id long, text string"
    assert quality.quality_rules(spark.createDataFrame([(1, text)], schema)).first().kept
    assert quality.quality_rules(spark.createDataFrame([], schema)).count() == 0


def test_filter_keeps_columns_of_any_name_and_reads_long_texts_whole(spark):
    long = "the plan of the " + " ".join(f"w{i}x" for i in range(60_000))
    rows = [(1, "the report of the plan " * 2 + " ".join(f"a{i}" for i in range(30)), 5, 6), (None, long, 7, 8), (3, long + " again" * 60_000, 1, 2)]
    out = quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, `x.y` int, n_words int"), {"n_words": (20, None)})
    assert out.columns == ["doc_id", "text", "x.y", "n_words"]
    assert sorted((r["doc_id"] or 0, r["x.y"], r["n_words"]) for r in out.collect()) == [(0, 7, 8), (1, 5, 6)]
