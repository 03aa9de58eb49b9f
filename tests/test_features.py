"""Features against plain Python on crafted texts, and what must hold for any text."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkgauge.functions import features as X
from inkgauge.functions import maths as M
from inkgauge.functions import text as T
from inkgauge.operators import detectors as D
from inkgauge.operators import evaluate, markdown, pairs, provenance
from inkgauge.operators.registry import Registry

HOSTILE = [
    None, "", "   ", "\n\n\n", "A" * 5000, "word " * 200, "```\nopen", "---\nopen front", "\0AI text", "é́ 漢字 🎉 ​", "½ x² don't",
    "one. Two! Three? (Four) 'five' 6", "- - -\n* a\n1. b\n> c\n| a |\n<p>\n# h\n", "  \x85", "In today's world, it is important to note that.",
]
ESSAY = "In today's world, it is important to note that we leverage robust tools. In conclusion, it plays a crucial role. Furthermore, a wide range of users delve into the landscape. Moreover, it is important to note that users utilize comprehensive tools. "
NOTE = "I burned the toast again. Twice, actually - the second time because I was staring at the cat, who had found a sock! It wasn't mine. Rain since noon; 3 mm, maybe 4. Who knows? Tomorrow we'll drive up to see June and her odd little boat, if the van starts. "


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*HOSTILE, ESSAY * 3, NOTE * 2])], "doc_id long, text string")


def words(t):
    return [w for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d+(?:\.\d+)?|[^\w\s]", t or "") if w[0].isalpha()]


def test_richness_matches_plain_python(docs):
    for r in X.richness(X.parsed(docs)).select("text", "n", "ttr", "hapax", "yules_k", "honores_r").collect():
        c = Counter(w.lower() for w in words((r["text"] or "").strip()))
        n = sum(c.values())
        assert r["n"] == n
        v1 = sum(k == 1 for k in c.values())
        assert r["ttr"] == pytest.approx(len(c) / n if n else 0)
        assert r["hapax"] == pytest.approx(v1 / n if n else 0)
        assert r["yules_k"] == pytest.approx(0 if n < 8 else 1e4 * (sum(k * k for k in c.values()) - n) / n**2)
        assert r["honores_r"] == pytest.approx(0 if n < 8 or v1 == len(c) else 100 * math.log(n) / (1 - v1 / len(c)))


def test_scores_are_finite_and_tell_styles_apart(docs):
    rows = {r["doc_id"]: r for r in D.detect(docs, {"the": 1, "and": 2, "it": 3}).collect()}
    assert len(rows) == len(HOSTILE) + 2
    for r in rows.values():
        for c in ("classical_score", "stylometric_score", "statistical_score", "ensemble_score", "ensemble_confidence"):
            assert 0 <= r[c] <= 1
    essay, note = rows[len(HOSTILE)], rows[len(HOSTILE) + 1]
    assert essay["classical_score"] > 0.45 > note["phrase_density"]
    assert essay["classical_score"] > note["classical_score"]
    assert rows[1]["classical_confidence"] == 0


def test_markdown_is_lossless(spark):
    rng = random.Random(5)
    kinds = ["# head\n", "text here\r\n", "- item\n", "```\n", "| a | b |\n", "> q\n", "---\n", "\n", "last"]
    texts = [t for t in HOSTILE if t] + ["".join(rng.choice(kinds) for _ in range(rng.randint(1, 20))) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    again = {r["doc_id"]: r["text"] for r in markdown.rendered(markdown.segments(d)).collect()}
    assert [again[i] for i in range(len(texts))] == texts
    kinds_of = {(r["doc_id"], r["kind"]) for r in markdown.segments(d).collect()}
    assert (texts.index("---\nopen front"), "frontmatter") in kinds_of


def test_windows_cover_all_tokens(spark):
    for n in (1, 47, 48, 49, 100, 139):
        d = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x).alias("a"))
        w = d.select(T.sliding_windows(F.col("a"), 48, 24).alias("w")).first()["w"]
        assert {x for part in w for x in part} == set(range(1, n + 1))
        assert all(len(p) == 48 for p in w[:-1])


def test_pairs(spark):
    rows = [(1, ESSAY, ESSAY), (2, "the cat sat", "quantum ledgers brew"), (3, "", ""), (4, None, "x")]
    out = {r["pair_id"]: r for r in pairs.compare(spark.createDataFrame(rows, "pair_id long, original string, rewritten string")).collect()}
    assert out[1]["similarity"] == pytest.approx(1) and out[1]["passed"] and out[1]["token_change_rate"] == 0
    assert out[2]["similarity"] < 0.5 and not out[2]["passed"]
    assert out[3]["unigram_jaccard"] == 1 and "empty" in out[3]["reasons"]


def test_small_helpers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(T.match_casing(F.lit("HELLO"), F.lit("word"))) == "WORD"
    assert get(T.match_casing(F.lit("Hello"), F.lit("word"))) == "Word"
    assert get(T.join_sentences(F.array(F.lit("One"), F.lit(" two. "), F.lit("three")))) == "One. two. three"
    block = "a" * 3000 + "\n\n" + "b" * 1000 + "\n\n" + "c" * 10
    chunks = get(T.prose_chunks(F.lit(block)))
    assert "".join(chunks) == block and len(chunks) == 2
    assert get(T.syllables(F.lit("readable"))) == 2 and get(T.syllables(F.lit("123"))) == 0
    assert get(M.finite_unit(F.lit(float("nan")), 0.3)) == 0.3
    html = '<meta name="generator" content="x"><meta property="og:title" content="y">'
    assert get(provenance.html_meta(F.lit(html))) == 1


def test_registry_isolates_failures(docs):
    r = Registry({})

    def odd(text):
        if "cat" in text:
            raise ValueError("no cats")
        return 0.9

    r.register_function("odd", odd)
    rows = r.detect(X.parsed(docs), ["odd", "missing"]).select("odd_score", "odd_error", "ensemble_score").collect()
    assert any(x["odd_error"] for x in rows) and all(0 <= x["ensemble_score"] <= 1 for x in rows)
    with pytest.raises(ValueError):
        r.register("classical", lambda d: d)
    with pytest.raises(KeyError):
        r.create("missing")


def test_files_and_config(spark, tmp_path):
    from inkgauge.config import ConfigError, load
    from inkgauge.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("one\ntwo")
    (tmp_path / "in/b.bin").write_bytes(b"\0\1")
    got = files.read_texts(spark, str(tmp_path / "in")).collect()
    assert [r["text"] for r in got] == ["one\ntwo"]
    assert {r["error"] is None for r in files.read_bytes(spark, str(tmp_path / "in"), most=3).collect()} == {True, False}
    (tmp_path / "c.toml").write_text("[detect]\nai_likely = 2.0\n")
    with pytest.raises(ConfigError):
        load(tmp_path / "c.toml")
    assert load().detect.window_tokens == 256


def test_evaluation_report_and_cli(spark, tmp_path, capsys):
    from inkgauge import cli
    from inkgauge.operators import evaluate

    d = spark.createDataFrame([(1, "# h\n" + ESSAY), (2, "```\ncode\n```\n"), (3, None)], "doc_id long, text string")
    got = evaluate.detect_documents(d, {})
    assert got.count() == 3 and "| docs |" in evaluate.report(got, "label").replace("label | docs", "docs")
    pair = spark.createDataFrame([(1, ESSAY, NOTE)], "pair_id long, original string, rewritten string")
    row = evaluate.evaluate(pair, {}).first()
    assert row["delta"] == pytest.approx(row["after"] - row["before"]) and not row["passed"]
    (tmp_path / "a.txt").write_text(ESSAY)
    assert cli.main(["detect", str(tmp_path), "--json"]) == 0 and "ensemble_score" in capsys.readouterr().out
    assert cli.main(["version"]) == 0
    assert cli.main(["--config", str(tmp_path / "none.toml"), "version"]) == 2


def test_batch_isolates_files_that_fail(spark, tmp_path, capsys):
    from inkgauge import cli
    from inkgauge.operators import evaluate

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(ESSAY)
    (tmp_path / "in/b.txt").write_bytes(b"caf\xe9 \xff\xfe")
    (tmp_path / "in/c.txt").write_text("\n")
    (tmp_path / "in/d.exe").write_text("not looked at")
    assert evaluate.detect_batch(spark, str(tmp_path / "in"), str(tmp_path / "out")) == (2, 1)
    rows = {r["name"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(rows) == ["a.md.score", "b.txt.score", "c.txt.score"]
    assert rows["b.txt.score"]["error"] == "not UTF-8" and rows["b.txt.score"]["ensemble_score"] is None and rows["a.md.score"]["label"]
    assert cli.main(["batch", str(tmp_path / "in"), str(tmp_path / "out2")]) == 1
    (tmp_path / "in/b.txt").unlink()
    assert cli.main(["batch", str(tmp_path / "in"), str(tmp_path / "out3")]) == 0
    assert cli.main(["doctor"]) == 0 and "numpy" in capsys.readouterr().out


def test_settings_are_found_and_checked(tmp_path, monkeypatch):
    from inkgauge.config import ConfigError, load

    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    assert load().seed == 13
    (tmp_path / "home/.config/inkgauge").mkdir(parents=True)
    (tmp_path / "home/.config/inkgauge/inkgauge.yml").write_text("seed: 5\n")
    assert load().seed == 5
    (tmp_path / "inkgauge.yaml").write_text("detect:\n  uncertain: 0.5\n  detectors: [classical]\n")
    assert load().detect.uncertain == 0.5 and load().detect.detectors == ("classical",) and load().seed == 13
    for text in ("a: [", "- 1\n", "unknown: 1\n", "detect:\n  uncertain: 7\n", "detect:\n  nothing: 1\n"):
        (tmp_path / "x.yaml").write_text(text)
        with pytest.raises(ConfigError):
            load(tmp_path / "x.yaml")
    with pytest.raises(ConfigError):
        load(tmp_path / "missing.toml")


def test_report_of_pairs(spark):
    from inkgauge.operators import evaluate

    pairs_of = spark.createDataFrame([(1, ESSAY, ESSAY), (2, ESSAY, NOTE), (3, "", "")], "pair_id long, original string, rewritten string")
    rows = evaluate.evaluate(pairs_of, {})
    got = {r["pair_id"]: r for r in rows.collect()}
    assert got[1]["passed"] and got[1]["delta"] == 0 and got[1]["target_met"] == (got[1]["after"] <= 0.4) and not got[2]["target_met"]
    told = evaluate.comparison_report(rows)
    assert told.startswith("# Before and after") and "| 2 |" in told and "target_met" in told


def test_similarity_by_vectors(spark):
    rows = [(1, "a b c", "x y z", [1.0, 0.0], [1.0, 0.0]), (2, "a b c", "a b c", [1.0, 0.0], [0.0, 1.0]), (3, "a b", "a b", None, [1.0]), (4, "a", "a", [0.0, 0.0], [1.0, 0.0])]
    d = spark.createDataFrame(rows, "pair_id long, original string, rewritten string, original_vector array<double>, rewritten_vector array<float>")
    got = {r["pair_id"]: (r["method"], r["similarity"]) for r in pairs.compare(d).collect()}
    assert got[1] == ("embeddings", 1.0) and got[2] == ("embeddings", 0.0) and got[4] == ("embeddings", 0.0)
    assert got[3][0] == "ngrams" and got[3][1] == pytest.approx(1)


def test_spans(spark, docs):
    get = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    text = "see https://a.example/b?jo@c.example, jo@c.example\n\U0001f389 x@y.example"
    want = []
    for p in (r"https?://[^\s)>\]]+", r"[\w.+\-]+@[\w\-]+\.[\w.\-]*\w"):
        want += [m.span() for m in re.finditer(p, text)]
    merged = []
    for a, b in sorted(want):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    assert [[s["start"], s["end"]] for s in get(T.protected_offsets(F.lit(text)))] == merged
    assert get(T.protected_offsets(F.lit(""))) == [] and get(T.overlaps(F.lit(3), F.lit(3), F.array(F.struct(F.lit(2).alias("start"), F.lit(9).alias("end")))))
    spans = F.expr("transform(sequence(1, 20), i -> named_struct('start', i, 'end', i + 1, 'score', double(i % 3)))")
    assert [s["start"] for s in get(D.promoted_spans(spans))] == [*range(2, 21, 3), *range(1, 21, 3), *range(3, 21, 3)][:16]
    assert get(D.whole_text_span(F.lit("a b"), F.lit(0.5)))[0]["end"] == 3 and get(D.whole_text_span(F.lit(" "), F.lit(0.5))) == []
    row = D.detect(docs, {}).withColumn("f", D.family_score("watermark")).select("f", "statistical_score", "spans", "hot_spans").collect()
    assert all(r["f"] == round(r["statistical_score"], 4) and len(r["spans"]) == min(16, len(r["hot_spans"])) for r in row)


def test_scan_equals_the_hash_column(spark, docs):
    """The Arrow scan against the same hash as JVM columns."""
    d = X.scanned(X.parsed(docs)).withColumn("g", F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: i))
    pair = lambda seed: F.zip_with(F.slice("lowers", 1, F.greatest(F.col("n") - 1, F.lit(0))), F.slice("lowers", 2, F.greatest(F.col("n") - 1, F.lit(0))), lambda p, t: X.green(p, t, seed))
    from inkgauge import lexicon

    seeds = lexicon.GREEN_SEEDS
    rows = d.select("scan.*", *[pair(s).alias(f"s{s}") for s in seeds]).collect()
    for r in rows:
        assert r["hits"] == [sum(r[f"s{s}"]) for s in seeds] and r["first"] == r[f"s{seeds[0]}"] and r["second"] == r[f"s{seeds[1]}"]


def test_unsplittable_scans_are_spread(spark, tmp_path):
    from inkgauge.sources import files

    spark.range(100).repartition(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / x)) for x in ("one", "many"))
    assert files.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and files.spread(one).count() == 100
    assert many.rdd.getNumPartitions() < 4 or files.spread(many) is many


def test_equal_sides_are_scored_once(spark, monkeypatch):
    rows, scored = [(1, "One thing is this. " * 9, "One thing is this. " * 9), (2, "One thing.", "Two things."), (3, None, None), (4, None, "")], []
    real = evaluate.detect
    monkeypatch.setattr(evaluate, "detect", lambda d, *a: scored.append(d.count()) or real(d, *a))
    got = {r["pair_id"]: r for r in evaluate.evaluate(spark.createDataFrame(rows, "pair_id long, original string, rewritten string"), {"the": 1}).collect()}
    assert scored == [6] and len(got) == 4
    for i in (1, 3):
        assert got[i]["before"] == got[i]["after"] is not None and got[i]["delta"] == 0 and got[i]["before_label"] == got[i]["after_label"]


def test_lists_keep_rows_of_slices():
    rows = pa.array([["a", "b"], [], ["c"], None, ["d"]])
    assert [list(x) for x in X.lists(rows.slice(1, 4))] == [[], ["c"], [], ["d"]]
