"""Command line: detect, batch, eval, audit (texts and pages), inspect (images and PDFs), doctor, config, version. `python -m inkgauge.cli detect DIR --json`"""

from __future__ import annotations

import argparse
import dataclasses
import importlib.util
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import ConfigError, load
from .functions import text as T
from .lexicon import word_ranks
from .operators import embedded, evaluate, provenance
from .operators.detectors import collected_ranks
from .sources import files


def _numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    return files.read_texts(spark, *paths).withColumnRenamed("path", "doc_id")


def _ranks(docs: DataFrame) -> dict[str, int]:
    return collected_ranks(word_ranks(docs.select(F.explode(T.lower_words(F.col("text"))).alias("tok"))))


def _checks(spark: SparkSession) -> dict[str, str]:
    """What the engine runs on, and what is missing of what it can use."""
    found = {"inkgauge": __version__, "python": sys.version.split()[0], "spark": spark.version, "master": spark.sparkContext.master}
    found["shared folder"] = spark.conf.get("spark.checkpoint.dir", None) or "spark.checkpoint.dir is not set"
    for name in ("numpy", "pandas", "pyarrow", "xxhash", "yaml"):
        spec = importlib.util.find_spec(name)
        found[name] = importlib.import_module(name).__version__ if spec and hasattr(importlib.import_module(name), "__version__") else "there" if spec else "missing"
    return found


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkgauge", description=__doc__)
    p.add_argument("--config")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("detect", "audit", "inspect"):
        v = verbs.add_parser(verb)
        v.add_argument("paths", nargs="+")
        v.add_argument("--json", action="store_true")
    v = verbs.add_parser("eval")
    v.add_argument("original")
    v.add_argument("rewritten")
    v.add_argument("--report", action="store_true")
    v = verbs.add_parser("batch")
    v.add_argument("source")
    v.add_argument("dest")
    v.add_argument("--suffix", default=".score")
    verbs.add_parser("doctor")
    verbs.add_parser("config")
    verbs.add_parser("version")
    o = p.parse_args(args)
    try:
        settings = load(o.config)
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    if o.verb == "version":
        print(__version__)
        return 0
    if o.verb == "config":
        print(json.dumps(dataclasses.asdict(settings), indent=2))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if o.verb == "doctor":
        for name, found in _checks(spark).items():
            print(f"{name}: {found}")
        return 0
    if o.verb == "batch":
        good, bad = evaluate.detect_batch(spark, o.source, o.dest, settings=settings, suffix=o.suffix)
        print(f"{good} scored, {bad} failed")
        return 0 if good and not bad else 1
    if o.verb == "detect":
        docs = _numbered(spark, o.paths)
        out = evaluate.detect_documents(docs, _ranks(docs), settings).select("doc_id", "ensemble_score", "ensemble_confidence", "label")
    elif o.verb == "audit":
        t = F.col("text")
        out = _numbered(spark, o.paths).select(
            "doc_id", provenance.html_meta(t).alias("metas"), provenance.html_link(t).alias("links"), provenance.json_ld(t).alias("json_ld"),
            provenance.xmp_packets(t).alias("xmp"), provenance.markers(t).alias("markers"),
        )
    elif o.verb == "inspect":
        found = embedded.audit(files.read_bytes(spark, *o.paths, glob=files.MEDIA_GLOB))
        told = F.coalesce("error", "embedded.error").alias("error")
        out = found.select("path", F.col("embedded.format").alias("format"), told, F.explode_outer("embedded.found").alias("f")).select("path", "format", "f.*", "error")
    else:
        one = lambda path, c: files.read_texts(spark, path, suffixes=None).select(F.lit(1).alias("pair_id"), F.col("text").alias(c))
        pair = one(o.original, "original").join(one(o.rewritten, "rewritten"), "pair_id")
        out = evaluate.evaluate(pair, _ranks(pair.select(F.col("original").alias("text"))), settings)
        if o.report:
            print(evaluate.comparison_report(out))
            return 0
    if o.verb == "eval" or o.json:
        for r in files.as_json(out).toLocalIterator():
            print(r["json"])
    else:  # every row, a partition at a time
        print("\t".join(out.columns))
        for r in out.toLocalIterator():
            print("\t".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else " ".join(str(v).split()) for v in r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
