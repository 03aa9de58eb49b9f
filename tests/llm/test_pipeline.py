"""The pipeline's stages, each against what a plain version makes of its own input."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from test_operators import plain_components, words

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and each stage's rows."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(["tion", "er", "an", "in", "ea", "st"], rng.integers(1, 4)))
    rows, labels = [], []
    for i in range(240):
        w = [word() for _ in range(60)]
        if i % 6 == 0:
            for k in rng.integers(0, 60, 8):
                w[k] = rng.choice(["blargus", "zonkpit", "quivmud"])
        text = " ".join(w) + ("\nshared footer line" if i % 4 == 1 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(300 + k, rows[7][1] + " extra", "en", "s1", 1) for k in range(3)]
    rows += [(400, None, None, None, None), (401, "", "en", None, 0), (None, "no id", "en", "s0", 5)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs.collect()]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, d).write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        assert k == len(P.STAGES) - 1 or docs.columns == P.COLUMNS
        out.append(docs.collect())
    return out


def test_toxic_documents_go_and_clean_ones_stay(stages):
    left = {r["doc_id"] for r in stages[1]}
    clean = {r["doc_id"] for r in stages[0] if r["doc_id"] is None or r["doc_id"] >= 240 or r["doc_id"] % 6}
    assert clean <= left and len(left - clean) <= 2


def test_lines_of_a_tenth_of_a_source_go(stages):
    before = {}
    for r in stages[1]:
        for line in {x.strip() for x in (r["text"] or "").split("\n")} - {""}:
            before.setdefault(r["source"], {}).setdefault(line, 0)
            before[r["source"]][line] += 1
    pages = {s: sum(r["source"] == s for r in stages[1]) for s in before}
    after = {r["doc_id"]: r["text"] for r in stages[2]}
    assert len(stages[2]) == len(stages[1])
    for r in stages[1]:
        if r["text"] is not None:
            keep = [x for x in r["text"].split("\n") if not (x.strip() and before[r["source"]][x.strip()] >= 5 and before[r["source"]][x.strip()] > 0.1 * pages[r["source"]])]
            assert after[r["doc_id"]] == "\n".join(keep)


def test_one_of_each_group_stays(stages):
    want = plain_components([(r["doc_id"], r["text"]) for r in stages[2]])
    assert sorted(str(r["doc_id"]) for r in stages[3]) == sorted(str(x) for x in [*(i for i, c in want.items() if i == c), None])


def test_mix_and_pack_agree(stages):
    sizes = {r["doc_id"]: len(words(r["text"])) for r in stages[3]}
    taken = {}
    for r in stages[4]:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert set(taken) <= set(sizes) and max(taken.values()) <= 3
    ends = [r for r in stages[5] if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == len(stages[4]) and len({r["sequence_id"] for r in stages[5]}) == len(stages[5])


def test_stages_on_awkward_tables(spark, tmp_path):
    """No rows; extra columns named like what the stages add; repeated ids of which one row stays."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "b " * 9, "en", "s", 18), (1, "a " * 9, "en", "s", 18), (1, None, "en", None, None), (2, "", None, None, 0), (None, "x", "de", "s", 1), (None, "x", "de", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    for c in ("score", "predicted", "held_out", "host", "kept_text", "n_dropped", "component_id", "component", "size", "target", "taken", "repetitions", "length", "start"):
        docs = docs.withColumn(c, F.lit("mine"))
    for k, (_, stage) in enumerate(P.STAGES):
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        got = stage(spark, docs, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert none.columns == got.columns == P.COLUMNS
    kept = P.near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "None", "None"]
    assert next(r["text"] for r in kept if r["doc_id"] == 1) == "a " * 9  # the first of the id's rows


def test_the_rest_works_without_these_operators(tmp_path):
    """__spark_entry__ with the package but without llm and the pipeline."""
    os.makedirs(tmp_path / "inkgauge")
    for p in os.listdir(f"{ROOT}/inkgauge"):
        if p != "llm":
            os.symlink(f"{ROOT}/inkgauge/{p}", tmp_path / "inkgauge" / p)
    os.symlink(f"{ROOT}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    said = subprocess.run(
        [sys.executable, "-c", "import json, sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"],
        cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""},
    )
    names = json.loads(said.stdout)
    assert "readability_richness" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
