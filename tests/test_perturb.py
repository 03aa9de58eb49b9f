"""Labelled perturbation and exact keyed hashes against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from inkgauge import lexicon
from inkgauge.functions import keyed
from inkgauge.functions import maths as M
from inkgauge.functions import text as T
from inkgauge.operators import edits, perturb

TEXTS = [
    None, "", "   ", "In summary, we leverage robust tools. IN ORDER TO delve into it, see https://a.example/in-order-to/leverage and leverage@b.example.",
    "releverage leveraged re-leverage _leverage leverage", "a wide range of a wide landscape, the landscape", "İn summary İ in summary", "é́ 漢字 leverage 🎉 leverage",
    "don't leverage; Leverage! ½ x² LEVERAGE", "leverage " * 3000, "in summary\nin summary", "cat Cat CAT cat's dog",
]
TABLE = {"in summary": ["in brief", "briefly"], "in order to": ["to"], "leverage": ["use", "apply"], "delve into": ["study"], "a wide": ["a broad"], "a wide range of": ["many"], "landscape": ["field"], "the landscape": ["the field"], "": ["x"], "none": []}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, note string")


def plain_phrases(text, doc, seed):
    """Leftmost, longest, by trying every phrase at every place."""
    spans = [m.span() for m in re.finditer(r"https?://\S+|[\w.+-]+@[\w-]+\.[\w.-]*\w", text)]
    out, at = [], 0
    while at < len(text):
        for p in sorted((p for p, o in TABLE.items() if p and o), key=len, reverse=True):
            end = at + len(p)
            bound = not (at and re.match(r"\w", text[at - 1])) and not re.match(r"\w", text[end : end + 1])
            if text[at:end].lower() == p and bound and not any(at < b and a < end for a, b in spans):
                h = int(hashlib.md5("\x1f".join((str(seed), str(doc), str(at), "phrase")).encode()).hexdigest()[:7], 16)
                out.append((at, end, text[at:end], perturb.cased_like(text[at:end], TABLE[p][h % len(TABLE[p])])))
                at = end
                break
        else:
            at += 1
    return out


def test_phrases_equal_a_plain_search(docs):
    rows = perturb.perturb_phrases(docs, TABLE, seed=5).withColumn("back", perturb.restored(F.col("perturbed"), F.col("edits"))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"]]
        assert r["text"] == text and r["note"] == "kept" and (r["strategy"], r["seed"]) == ("phrases", 5)
        if text is None:
            assert r["perturbed"] is None and r["edits"] == [] and r["n_edits"] == 0
            continue
        want = plain_phrases(text, r["doc_id"], 5)
        assert [tuple(e) for e in r["edits"]] == want and r["n_edits"] == len(want)
        assert r["perturbed"] == perturb.applied(text, want) and r["back"] == text
    again = perturb.perturb_phrases(docs.repartition(7), TABLE, seed=5).collect()
    assert {(r["doc_id"], r["perturbed"]) for r in again} == {(r["doc_id"], r["perturbed"]) for r in rows}
    assert "https://a.example/in-order-to/leverage" in rows[3]["perturbed"] and rows[3]["perturbed"].startswith(("In brief", "Briefly"))


def test_phrases_of_an_empty_table(docs):
    assert all(r["perturbed"] == r["text"] and r["n_edits"] == 0 for r in perturb.perturb_phrases(docs, {}).collect())
    assert perturb.perturb_phrases(docs.limit(0), TABLE).collect() == []


def test_words_are_targets_and_rebuilding_loses_nothing(spark, docs):
    ranks = spark.createDataFrame([("in", 3), ("a", 5), ("use", 90)], "word string, rank int")
    table = spark.createDataFrame([("leverage", ["use", "apply"]), ("cat", ["bird"]), ("dog", ["dog"]), ("landscape", ["field"])], "word string, options array<string>")
    d = perturb.perturb_words(docs, ranks, table, strength=1.0, seed=2).withColumn("back", perturb.restored(F.col("perturbed"), F.col("edits")))
    rows = {r["doc_id"]: r for r in d.collect()}
    words = docs.select("doc_id", F.posexplode(T.lower_words(F.coalesce("text", F.lit("")))).alias("pos", "tok")).withColumn("pos", F.col("pos") + 1)
    ranked = edits.priorities(words, ranks).withColumn("priority", F.round("priority", 6))
    u = lambda d, p, k: int(hashlib.md5(f"2\x1f{d}\x1f{p}\x1f{k}".encode()).hexdigest()[:7], 16)
    options, want = {"leverage": ["use", "apply"], "cat": ["bird"], "landscape": ["field"]}, {}
    for r in edits.targets(ranked, 1.0).collect():
        if r["tok"] in options and u(r["doc_id"], r["pos"], "keep") / 2**28 >= 0.55 - 0.35:
            want.setdefault(r["doc_id"], {})[r["pos"]] = options[r["tok"]][u(r["doc_id"], r["pos"], "choice") % len(options[r["tok"]])]
    assert set(rows) == set(range(len(TEXTS))) and sum(map(len, want.values())) > 100
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert r["text"] == text and r["n_edits"] == len(want.get(i, {})) == len(r["edits"])
        if text is None:
            assert r["perturbed"] is None
            continue
        assert r["back"] == text
        assert [e["new"].lower() for e in r["edits"]] == [w for _, w in sorted(want.get(i, {}).items())]
        assert all(text[e["start"] : e["end"]] == e["old"] for e in r["edits"])
        assert r["perturbed"] == perturb.applied(text, [tuple(e) for e in r["edits"]])
    shouted = [e["new"] for i in rows for e in rows[i]["edits"] if e["old"].isupper()]
    assert shouted and all(w.isupper() for w in shouted)


def test_steadiness_keeps_both_scores(spark, docs):
    d = perturb.perturb_phrases(docs.where("text is not null"), TABLE)
    out = perturb.steadiness(d, lambda x: x.withColumn("score", F.length("text").cast("double"))).collect()
    assert len(out) == len(TEXTS) - 1
    for r in out:
        assert r["text"] == TEXTS[r["doc_id"]] and r["moved"] == len(r["perturbed"]) - len(r["text"]) == r["score_after"] - r["score_before"]


def test_words_and_offsets_agree_with_tokens(docs):
    rows = docs.where("text is not null").select("text", perturb.word_pieces(F.col("text")).alias("p"), T.words(F.col("text")).alias("w")).collect()
    for r in rows:
        assert "".join(x["gap"] + (x["own"] or "") + x["tail"] for x in r["p"]) == r["text"]
        assert [x["own"] for x in r["p"] if x["own"]] == r["w"]


MARKDOWN = [
    "---\ntitle: keep\n---\n# Head\n\nFirst paragraph.  \n\nSecond one\n\n- item a\n- item b\n> said\n\n```\ncode = 1\n```\n| a | b |\n<div>\ntail  ",
    "para one\n\npara bad two\n\npara three", "", None, "   \n", "```\nonly code", "x" * 50 + "\n\n" + "bad",
]


def test_markdown_comes_back_whole_and_failures_keep_their_text(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(MARKDOWN)], "doc_id long, text string")
    for f in (lambda t: t, perturb.guarded(lambda t: t)):
        for limit in (1, 10, 3500):
            rows = perturb.apply_to_markdown(d, f, limit=limit).collect()
            assert len(rows) == len(MARKDOWN) and all(r["perturbed"] == r["text"] == MARKDOWN[r["doc_id"]] and r["n_edits"] == r["n_failed"] == 0 for r in rows)

    def shout(t):
        if "bad" in t:
            raise RuntimeError("no")
        return t.upper()

    got = {r["doc_id"]: r for r in perturb.apply_to_markdown(d, perturb.guarded(shout), limit=12).collect()}
    assert got[1]["perturbed"] == "PARA ONE\n\npara bad two\n\nPARA THREE" and got[1]["n_failed"] == 1 and got[1]["n_edits"] == 2
    for kept in ("title: keep", "# Head", "code = 1", "| a | b |", "<div>"):
        assert kept in got[0]["perturbed"]
    assert "FIRST PARAGRAPH.  \n" in got[0]["perturbed"] and "- ITEM A\n" in got[0]["perturbed"] and got[0]["perturbed"].endswith("TAIL  ")
    assert got[5]["perturbed"] == MARKDOWN[5] and got[5]["n_chunks"] == 0 and got[3]["perturbed"] is None


def test_rejected_steps_leave_no_trace(spark):
    long = "We leverage the tools in order to see the old river and the cold hills. " * 6
    d = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "leverage")], "doc_id long, text string")
    steps = [
        perturb.phrases_step(TABLE), perturb.column_step("half", lambda t: F.substr(t, F.lit(1), F.lit(20))), perturb.column_step("gone", lambda t: F.lit("")),
        perturb.column_step("fails", perturb.guarded(lambda t: 1 / 0)), perturb.column_step("dot", lambda t: F.concat(t, F.lit("."))),
    ]
    got = {r["doc_id"]: r for r in perturb.perturb_stack(d, steps).collect()}
    r = got[1]
    phrases = next(x for x in perturb.perturb_phrases(d, TABLE).collect() if x["doc_id"] == 1)
    assert r["text"] == long and r["perturbed"] == phrases["perturbed"] + "." and r["strategy"] == "phrases+dot"
    assert r["n_edits"] == phrases["n_edits"] + 1
    assert r["notes"][0] == f"phrases:edits={phrases['n_edits']}" and r["notes"][1].startswith("half:rejected(too short") and r["notes"][2].startswith("gone:rejected(")
    assert r["notes"][3:] == ["fails:noop", "dot:edits=1"]
    assert got[2]["perturbed"] is None and got[2]["strategy"] == "identity" and got[2]["notes"] == [f"{s.name}:noop" for s in steps]
    assert got[3]["text"] == "" and len(got) == 4
    # Without the steps that were rejected the result is the same.
    less = perturb.perturb_stack(d.where("doc_id = 1"), [steps[0], steps[4]]).first()
    assert less["perturbed"] == r["perturbed"] and less["n_edits"] == r["n_edits"]


def test_exact_hash_and_generator(spark):
    rows = [("", None), ("a", "b"), ("é", "\x1f"), ("x" * 10_000, "漢")]
    d = spark.createDataFrame(rows, "a string, b string")
    for seed in (0, 13, -1, -(1 << 63), (1 << 63) - 1):

        def plain(a, b, seed=seed):
            h = hashlib.blake2b(digest_size=8)
            h.update(int(seed).to_bytes(8, "little", signed=True))
            for part in (a, b or "", "7"):
                h.update(b"\x1f" + part.encode())
            return int.from_bytes(h.digest(), "little")

        got = d.withColumn("h", keyed.blake_hash(["a", "b", F.lit(7)], seed)).withColumns(
            {"u": keyed.uniforms(F.col("h"), 3), "c": keyed.choices(F.col("h"), F.array(F.lit(5), F.lit(0), F.lit(1), F.lit(1000)))}
        )
        for r in got.collect():
            h = plain(r["a"], r["b"])
            assert int(r["h"]) == h
            rng = random.Random(h)
            assert r["u"] == [rng.random() for _ in range(3)]
            rng = random.Random(h)
            assert r["c"] == [rng.choice(range(5)), -1, rng.choice(range(1)), rng.choice(range(1000))]
    with pytest.raises(ValueError):
        keyed.blake_hash(["a"], 1 << 63)
    none = d.select(keyed.uniforms(F.lit(None).cast("string"), 2).alias("u")).first()
    assert none["u"] is None
    assert lexicon.PHRASE_SWAPS and d.select(M.uniform([F.col("a")], 3)).count() == 4


def test_a_stack_has_few_python_processes(spark):
    """Each exchange with Python is a process of its own in every task, and each holds a batch of texts."""
    steps = [perturb.phrases_step(TABLE), perturb.column_step("half", lambda t: F.substr(t, F.lit(1), F.lit(20))), perturb.column_step("same", lambda t: t)]
    d = spark.createDataFrame([(1, "a wide range of things. " * 9), (2, None)], "doc_id long, text string")
    plan = perturb.perturb_stack(d, steps)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython|MapInArrow|PythonMapInArrow", plan)) <= 1 + len(steps)
