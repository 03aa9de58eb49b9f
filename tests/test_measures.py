"""The measures of whole batches against the columns of features.py and plain counts."""

from collections import Counter

from pyspark.sql import functions as F

from inkgauge.functions import features as X
from inkgauge.functions import measures
from inkgauge.functions import text as T
from inkgauge.operators import detectors as D
from inkgauge.operators import evaluate

LONG = "Every day the fox goes out. It isn't far! Is it? " * 12
TEXTS = [
    None, "", "   \n ", "a", "ab", " a  b ", "rock'n'roll'n'more isn't 1.2.3 x2.5", "'a' b'' 'c'd'e' f'1 1'f", "ÉTÉ ΣΑΣ ΑΣ. İstanbul İS! Straße ﬁn Kelvin",
    "½delve into it. In conclusion, ½in conclusion. It's important to note that robust robust; cutting-edge, cutting edge", LONG, LONG.upper(),
    "In conclusion, one. " * 3 + LONG + "This article ends. Picture this.", "x" * 70 + " " + "y" * 30 + " " + "é" * 40 + " x", "漢字 かな 漢字。 二つ. A ² b ⅷ c_d _e", LONG * 4 + "tail",
    "One.\x1cTwo!\x85 Three? \"Four\" (five) - six... Seven—eight; nine: ten, " * 3, "  A. B. c. 9. ", "the and of to " * 60, "q. " * 30, "😀 one 😀 two 😀", "a\x1f\x1fb\tc",
    "Ünï " + LONG + " ünï", "e e be ee the eye ye", "Im Original steht article. " + "Le monde entier, un article important. " * 9,
]
RANKS = {"the": 1, "and": 2, "it": 3, "is": 90, "fox": 260, "straße": 300}


def _docs(spark):
    return spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string").repartition(2)


def test_measures_equal_the_columns(spark):
    want = D.statistical(D.stylometric(D.classical(X.parsed(_docs(spark)), RANKS)), RANKS).select("doc_id", "n", *measures.FEATURES, "hot_spans")
    got = measures.measured(_docs(spark), RANKS).select("doc_id", "n", *measures.FEATURES, "hot_spans")
    want, got = ({r["doc_id"]: r.asDict(recursive=True) for r in d.collect()} for d in (want, got))
    assert len(got) == len(TEXTS)
    for i, row in want.items():
        for c, v in row.items():
            if c == "hot_spans":
                assert [(s["start"], s["end"]) for s in v] == [(s["start"], s["end"]) for s in got[i][c]], (i, c)
            else:
                assert abs(v - got[i][c]) < 1e-9 * max(1, abs(v)), (TEXTS[i], c, v, got[i][c])


def test_measures_are_a_texts_own():
    """Whatever else is in the batch; only the order of sums may differ."""
    for t, row in zip(TEXTS, measures.features([t or "" for t in TEXTS], RANKS).to_pylist(), strict=True):
        alone = measures.features([t or ""], RANKS).to_pylist()[0]
        assert all(row[c] == alone[c] if c == "hot_spans" else abs(row[c] - alone[c]) < 1e-9 * max(1, abs(row[c])) for c in row), t


def test_comparison_equals_plain_counts(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(TEXTS, [*TEXTS[1:], None], strict=True))] + [(100, LONG, LONG)]
    d = spark.createDataFrame(rows, "i long, a string, b string").repartition(2)
    sides = [f(F.coalesce(F.col(c), F.lit(""))).alias(f"{n}{c}") for c in "ab" for n, f in (("w", T.lower_words), ("g", T.char_ngrams), ("s", T.sentences))]
    syll = [T.total_syllables(T.words(F.coalesce(F.col(c), F.lit("")))).alias(f"y{c}") for c in "ab"]
    for r in d.select("i", measures.comparison("a", "b").alias("m"), *sides, *syll).collect():
        m, p, q, g, h = r.m, Counter(r.wa), Counter(r.wb), Counter(r.ga), Counter(r.gb)
        square = lambda x, y: sum(x[k] * y[k] for k in x)
        assert (m.dot, m.aa, m.bb, m.common, m.na, m.nb) == (square(p, q), square(p, p), square(q, q), sum((p & q).values()), sum(p.values()), sum(q.values())), r.i
        assert (m.inter, m.either, m.g_dot, m.g_aa, m.g_bb) == (len(p & q), len(p | q), square(g, h), square(g, g), square(h, h)), r.i
        assert (m.sents_a, m.sents_b, m.syll_a, m.syll_b) == (len(r.sa), len(r.sb), r.ya, r.yb), r.i


def test_word_counts(spark):
    words = X.parsed(_docs(spark)).select(F.explode("lowers").alias("tok"))
    got = measures.word_counts(_docs(spark)).groupBy("tok").agg(F.sum("n").alias("n"))
    assert {r.tok: r.n for r in got.collect()} == {r.tok: r["count"] for r in words.groupBy("tok").count().collect()}


def test_pairs_are_evaluated_without_patterns_in_the_jvm(spark):
    """A side's features are one pass over its text, a pair's counts another: no pattern of the JVM's goes over the texts."""
    pairs = spark.createDataFrame([(1, LONG, "Short. " + LONG)], "pair_id long, original string, rewritten string")
    plan = evaluate.evaluate(pairs, RANKS)._jdf.queryExecution().executedPlan().toString().lower()
    for slow in ("regexp_extract_all", "regexp_replace", "regexp_count", "split("):
        assert slow not in plan, slow
