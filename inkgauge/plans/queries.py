"""The registered queries over the measurement operators. Their SQL is in sql.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon
from ..config import Settings
from ..functions import features as X
from ..functions import keyed
from ..functions import maths as M
from ..functions import measures
from ..functions import text as T
from ..operators import detectors as D
from ..operators import edits, embedded, evaluate, markdown, pairs, perturb, provenance
from ..sources.files import output_name, shared_folder, spread
from ..streaming import detect as stream
from . import made_files, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of documents; every fifth begins with stock phrases."""
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(sql.INJECTED.replace("''", "\\'")).alias("text"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.parsed(injected(spark, sf_dir))


def shown(d: DataFrame, *columns: str) -> DataFrame:
    """Columns with whole numbers as long and others rounded to six places."""
    kinds = dict(d.select(*columns).dtypes)

    def one(c: str):
        if kinds[c] in ("double", "float") or kinds[c].startswith("decimal"):
            return F.round(F.col(c).cast("double"), 6).alias(c)
        return F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c)

    return d.select(*map(one, columns))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos (from 1), tok."""
    rows = injected(spark, sf_dir).select("doc_id", F.posexplode(T.lower_words(T.strip(F.col("text")))).alias("pos", "tok"))
    return rows.withColumn("pos", F.col("pos") + 1)


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.word_ranks(words(spark, sf_dir))


def known_ranks(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return D.collected_ranks(lexicon.word_ranks(measures.word_counts(injected(spark, sf_dir))))


@query
def token_kind_counts(spark, sf_dir):
    d = parsed(spark, sf_dir)
    d = d.withColumn("kinds", F.transform("toks", T.kind))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k))
    d = d.select("doc_id", F.size("toks").alias("n_tokens"), count("word").alias("n_words"), count("number").alias("n_numbers"), count("punct").alias("n_punct"))
    return shown(d, *d.columns)


@query
def top_tokens(spark, sf_dir):
    """Counted by document first, within each row's partition: a token's documents are then rows."""
    per = words(spark, sf_dir).groupBy("tok", "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("tok").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).orderBy(F.col("n").desc(), "tok").limit(50)


@query
def sentence_stats(spark, sf_dir):
    d = X.sentence_lengths(parsed(spark, sf_dir)).withColumn("n_sentences", F.size("sents"))
    return shown(d, "doc_id", "n_sentences", "mean_sl", "std_sl", "burstiness", "length_uniformity")


@query
def paragraph_stats(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n \nEnd."))).otherwise(F.col("text"))
    d = read(spark, sf_dir, "documents").select("doc_id", T.paragraphs(text).alias("p"))
    longest = F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0))
    return shown(d.withColumn("n_paragraphs", F.size("p")).withColumn("longest", longest), "doc_id", "n_paragraphs", "longest")


@query
def sanitize_lengths(spark, sf_dir):
    dirty = F.concat("text", F.lit("\x07\t\x1f"))
    return shown(read(spark, sf_dir, "documents").withColumn("n_clean", F.length(T.sanitize(dirty))), "doc_id", "n_clean")


@query
def char_trigrams(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", T.char_ngrams(F.col("text")).alias("g"))
    return shown(d.select("doc_id", F.size("g").alias("n_trigrams"), F.size(F.array_distinct("g")).alias("n_distinct")), "doc_id", "n_trigrams", "n_distinct")


@query
def ngram_reuse(spark, sf_dir):
    d = X.counted(parsed(spark, sf_dir))
    return shown(d.withColumn("ngram_reuse", X.triple_reuse(F.col("n"))), "doc_id", "ngram_reuse")


@query
def window_counts(spark, sf_dir):
    d = parsed(spark, sf_dir).withColumn("w", T.window_starts(F.size("toks"), 256, 128))
    return shown(d.withColumn("n_windows", F.size("w")).withColumn("last_start", F.array_max("w")), "doc_id", "n_windows", "last_start")


@query
def readability_richness(spark, sf_dir):
    d = X.richness(parsed(spark, sf_dir)).withColumn("flesch", X.readability(F.col("sents"), F.col("words"), F.col("word_counts.syllables")))
    d = d.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return shown(d, "doc_id", "n", "flesch", "ttr", "hapax", "yules_k", "honores_r", "quality", "toxic")


@query
def zipf_perplexity(spark, sf_dir):
    d = parsed(spark, sf_dir).withColumn("perplexity", D.perplexity(F.col("lowers"), known_ranks(spark, sf_dir)))
    return shown(d, "doc_id", "perplexity")


@query
def function_words(spark, sf_dir):
    d = parsed(spark, sf_dir)
    d = d.withColumn("function_word_ratio", X.function_word_ratio(F.col("lowers"))).withColumn("function_word_fit", X.function_word_fit(F.col("lowers")))
    return shown(d, "doc_id", "function_word_ratio", "function_word_fit")


@query
def phrase_density(spark, sf_dir):
    return shown(parsed(spark, sf_dir).withColumn("phrase_density", X.phrase_density(F.col("raw"), F.col("n"))), "doc_id", "phrase_density")


@query
def opener_scores(spark, sf_dir):
    return shown(parsed(spark, sf_dir).withColumn("opener_score", X.opener_score(F.col("sents"))), "doc_id", "opener_score")


@query
def punctuation_uniformity(spark, sf_dir):
    return shown(X.punctuation(parsed(spark, sf_dir)), "doc_id", "punctuation_uniformity")


@query
def bigram_entropy(spark, sf_dir):
    return shown(X.counted(parsed(spark, sf_dir)).withColumn("bigram_entropy", X.bigram_entropy(F.col("n"))), "doc_id", "bigram_entropy")


@query
def sentence_flow(spark, sf_dir):
    d = parsed(spark, sf_dir)
    d = d.withColumn("start_diversity", X.start_diversity(F.col("sent_words"))).withColumn("adjacent_similarity", X.adjacent_similarity(F.col("sent_words")))
    return shown(d, "doc_id", "start_diversity", "adjacent_similarity")


@query
def style_ratios(spark, sf_dir):
    return shown(X.style_ratios(parsed(spark, sf_dir)), "doc_id", "comma_ratio", "contraction_ratio", "digit_ratio", "avg_syllables", "mean_wl", "quote_count")


@query
def classical_score(spark, sf_dir):
    return shown(D.classical(parsed(spark, sf_dir), known_ranks(spark, sf_dir)), "doc_id", "n", "classical_score", "classical_confidence")


@query
def stylometric_score(spark, sf_dir):
    return shown(D.stylometric(parsed(spark, sf_dir)), "doc_id", "n", "stylometric_score", "stylometric_confidence")


@query
def green_scan(spark, sf_dir):
    """Not rounded: whole numbers are divided once, so any engine has the same doubles, and rounding would only differ in ties."""
    d = X.multiseed_scan(parsed(spark, sf_dir))
    return d.select("doc_id", "max_z", "mean_abs_z", "z_std", "mean_rate", "max_rate", F.col("best_seed").cast("long").alias("best_seed"))


@query
def context_consistency(spark, sf_dir):
    return shown(X.context_consistency(parsed(spark, sf_dir)), "doc_id", "context_consistency")


@query
def window_spikes(spark, sf_dir):
    return shown(X.window_spike(parsed(spark, sf_dir)), "doc_id", "window_spike")


@query
def rare_alignment(spark, sf_dir):
    common = [w for w, r in known_ranks(spark, sf_dir).items() if r <= lexicon.COMMON_RANK]
    return shown(X.rare_alignment(parsed(spark, sf_dir), common), "doc_id", "rare_alignment")


@query
def hot_spans(spark, sf_dir):
    # explode() would bring in a filter that works the spans out twice.
    rows = X.hot_spans(parsed(spark, sf_dir)).select("doc_id", F.explode_outer("hot_spans").alias("s")).where("s is not null")
    d = rows.select("doc_id", "s.start", "s.end", "s.score")
    return shown(d, *d.columns)


@query
def statistical_score(spark, sf_dir):
    return shown(D.statistical(parsed(spark, sf_dir), known_ranks(spark, sf_dir)), "doc_id", "n", "statistical_score", "statistical_confidence")


@query
def ensemble_score(spark, sf_dir):
    d = D.detect(injected(spark, sf_dir), known_ranks(spark, sf_dir))
    return shown(d, "doc_id", "ensemble_score", "ensemble_confidence", "agreement", "family", "label")


@query
def label_distribution(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(sql.INJECTED.replace("''", "\\'")).alias("text"))
    return D.detect(docs, known_ranks(spark, sf_dir)).groupBy("lang", "label").agg(F.count("*").alias("n"))


@query
def windowed_detect(spark, sf_dir):
    d = D.detect_windows(injected(spark, sf_dir), known_ranks(spark, sf_dir), Settings())
    return shown(d, "doc_id", "win", "n", "classical_score", "classical_confidence")


def _markdown(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(sql.MARKDOWN.replace("chr(", "char(")).alias("text"))


@query
def markdown_segments(spark, sf_dir):
    d = markdown.segments(_markdown(spark, sf_dir))
    return shown(d, *d.columns)


@query
def prose_only_text(spark, sf_dir):
    return markdown.prose_only(_markdown(spark, sf_dir))


@query
def prose_detect(spark, sf_dir):
    """The stylometric detector over documents' prose alone."""
    return shown(D.stylometric(X.parsed(markdown.prose_only(_markdown(spark, sf_dir)))), "doc_id", "n", "stylometric_score", "stylometric_confidence")


@query
def reconstructed(spark, sf_dir):
    """Three edits of each text, of which the second overlaps the third and the text may be too short for them."""
    edits = F.expr("array(named_struct('start', 0, 'end', 1, 'new', '<'), named_struct('start', 5, 'end', 9, 'new', 'lost'), named_struct('start', 8, 'end', 10, 'new', '>'))")
    return read(spark, sf_dir, "documents").select("doc_id", T.reconstruct(F.col("text"), edits).alias("text"))


@query
def edit_targets(spark, sf_dir):
    ranked = edits.priorities(words(spark, sf_dir), ranks(spark, sf_dir))
    # Rounded before it is ordered by, so that equal priorities are ties in any engine.
    return shown(edits.targets(ranked.withColumn("priority", F.round("priority", 6))), "doc_id", "pos", "tok", "priority", "place")


@query
def perturbed_phrases(spark, sf_dir):
    """Stock phrases of the texts replaced; the query tells that the edits take the changed text back to the original."""
    d = perturb.perturb_phrases(injected(spark, sf_dir), lexicon.PHRASE_SWAPS)
    first = F.coalesce(F.get("edits", F.lit(0))["start"], F.lit(-1))
    same = perturb.restored(F.col("perturbed"), F.col("edits")) == F.col("text")
    return shown(d.select("doc_id", "n_edits", first.alias("first_start"), same.alias("restores"), "strategy"), "doc_id", "n_edits", "first_start", "restores", "strategy")


@query
def perturbed_words(spark, sf_dir):
    """Target words replaced by their neighbours in the corpus's list of ranks."""
    listed = ranks(spark, sf_dir).persist()
    near = [listed.select((F.col("rank") - k).alias("rank"), F.col("word").alias(f"w{k}")) for k in (1, 2)]
    table = listed.join(near[0], "rank", "left").join(near[1], "rank", "left").select("word", F.array_compact(F.array("w1", "w2")).alias("options"))
    d = perturb.perturb_words(injected(spark, sf_dir), listed, table.where(F.size("options") > 0))
    same = perturb.restored(F.col("perturbed"), F.col("edits")) == F.col("text")
    return shown(d.select("doc_id", "n_edits", F.md5("text").alias("original"), F.md5("perturbed").alias("digest"), same.alias("restores")), "doc_id", "n_edits", "original", "digest", "restores")


@query
def perturbed_markdown(spark, sf_dir):
    """The prose of markdown documents with figures for vowels, all else as it is."""
    d = perturb.apply_to_markdown(_markdown(spark, sf_dir), lambda t: F.translate(t, "aeiou", "43102"))
    return shown(d.withColumn("changed", F.col("n_edits") > 0), "doc_id", "perturbed", "n_failed", "changed")


@query
def perturbed_stack(spark, sf_dir):
    """Three steps over every text: phrases, a cut that the gate rejects where it is too short, and one that changes nothing."""
    cut = perturb.column_step("cut", lambda t: F.substr(t, F.lit(1), (F.length(t) / 2).cast("int")))
    d = perturb.perturb_stack(injected(spark, sf_dir), [perturb.phrases_step(lexicon.PHRASE_SWAPS), cut, perturb.column_step("same", lambda t: t)])
    return shown(d.select("doc_id", "n_edits", "strategy", F.array_join("notes", ";").alias("notes")), "doc_id", "n_edits", "strategy", "notes")


@query
def exact_keyed_hash(spark, sf_dir):
    """BLAKE2b of the documents' beginnings and the first number of the generator that it seeds; SQL has neither."""
    d = read(spark, sf_dir, "documents").select("doc_id", keyed.blake_hash([F.substr("text", F.lit(1), F.lit(80)), F.lit("lexical"), F.lit(42)], 13).alias("hash"))
    return d.select("doc_id", F.col("hash").cast("string").alias("hash"), keyed.uniforms(F.col("hash"), 1)[0].alias("u"))


def _pairs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("original"),
        F.when(F.col("doc_id") % 3 == 0, F.col("text"))
        .when(F.col("doc_id") % 3 == 1, F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
        .otherwise(F.concat(F.lit("It is a short note. "), "text", F.lit(" It ends."))).alias("rewritten"),
    )


@query
def pair_compare(spark, sf_dir):
    d = pairs.compare(_pairs(spark, sf_dir))
    return shown(d, "pair_id", "similarity", "word_cosine", "char_cosine", "unigram_jaccard", "token_change_rate", "length_ratio", "original_tokens", "rewritten_tokens")


@query
def quality_gate(spark, sf_dir):
    d = pairs.compare(_pairs(spark, sf_dir))
    return shown(d.withColumn("reasons", F.array_join("reasons", ",")), "pair_id", "readability_before", "readability_after", "changed_tokens", "method", "reasons", "passed")


@query
def evaluated_pairs(spark, sf_dir):
    """Both sides' ensemble scores, the gate, and whether the target is met."""
    d = evaluate.evaluate(_pairs(spark, sf_dir), known_ranks(spark, sf_dir))
    return shown(d, "pair_id", "before", "after", "delta", "before_label", "after_label", "passed", "target_met")


@query
def embedding_cosine(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("b"))
    return shown(e.join(other, "vec_id").withColumn("cosine", pairs.vector_cosine(F.col("embedding"), F.col("b"))), "vec_id", "other_id", "cosine")


@query
def protected_spans(spark, sf_dir):
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" see https://a.example/x?y=1 "))).otherwise(F.col("text"))
    d = read(spark, sf_dir, "documents").withColumn("x", text)
    return shown(d.withColumn("urls", F.regexp_count("x", F.lit(T.URL))).withColumn("emails", F.regexp_count("x", F.lit(T.EMAIL))), "doc_id", "urls", "emails")


@query
def provenance_audit(spark, sf_dir):
    h = F.when(F.col("page_id") % 4 == 0, F.replace("html", F.lit("<head>"), F.lit(sql.MARKS))).otherwise(F.col("html"))
    d = read(spark, sf_dir, "pages").select("page_id", h.alias("h"))
    d = (
        d.withColumn("metas", provenance.html_meta(F.col("h"))).withColumn("links", provenance.html_link(F.col("h")))
        .withColumn("json_ld", provenance.json_ld(F.col("h"))).withColumn("xmp", provenance.xmp_packets(F.col("h")))
        .withColumn("markers", F.size(provenance.markers(F.col("h"))))
    )
    return shown(d, "page_id", "metas", "links", "json_ld", "xmp", "markers")


@query
def corpus_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(sql.INJECTED.replace("''", "\\'")).alias("text"))
    d = X.richness(X.parsed(docs)).withColumn("flesch", X.readability(F.col("sents"), F.col("words"), F.col("word_counts.syllables")))
    # One row for each language and source is summed before the roll-up, so the roll-up doesn't multiply the corpus.
    parts = d.groupBy("lang", "source").agg(F.count("*").alias("d"), F.sum("n").alias("w"), F.sum("flesch").alias("f"), F.sum("ttr").alias("t"))
    out = parts.rollup("lang", "source").agg(
        F.sum("d").alias("docs"), F.sum("w").alias("words"), (F.sum("f") / F.sum("d")).alias("flesch"), (F.sum("t") / F.sum("d")).alias("ttr")
    )
    return shown(out, "lang", "source", "docs", "words", "flesch", "ttr")


@query
def score_vs_labels(spark, sf_dir):
    d = D.stylometric(parsed(spark, sf_dir)).select("doc_id", "stylometric_score").join(read(spark, sf_dir, "labels"), "doc_id")
    return shown(d.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.avg("stylometric_score").alias("mean_score")), "quality", "toxic", "docs", "mean_score")


@query
def scalar_math(spark, sf_dir):
    x = F.col("n_chars").cast("double")
    d = read(spark, sf_dir, "documents").withColumn("logistic", M.logistic(x, 1500, 0.001)).withColumn("clamped", M.clamp(x / 3000.0)).withColumn("band", M.target_band(x, 500.0, 1500.0))
    return shown(d, "doc_id", "logistic", "clamped", "band")


@query
def keyed_uniform(spark, sf_dir):
    return shown(read(spark, sf_dir, "documents").withColumn("u", M.uniform([F.col("doc_id").cast("string"), F.col("lang")], 13)), "doc_id", "u")


@query
def json_rows(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang")).alias("json"))


@query
def detector_records(spark, sf_dir):
    """Each document's three detectors as records, a row for each of their signals."""
    d = D.detect(injected(spark, sf_dir), known_ranks(spark, sf_dir))
    records = d.select("doc_id", F.explode(F.array(*[D.result(n) for n in D.MEMBERS])).alias("r")).select("doc_id", "r.*")
    flat = records.select("doc_id", "name", "family", "score", "confidence", "label", F.explode("signals").alias("s"))
    return shown(flat.select("*", F.col("s.name").alias("signal"), "s.value", "s.weight").drop("s"), "doc_id", "name", "family", "score", "confidence", "label", "signal", "value", "weight")


@query
def promoted_spans(spark, sf_dir):
    """The strongest hot windows that the ensemble reports, in the order of their strength."""
    d = X.hot_spans(parsed(spark, sf_dir)).select("doc_id", F.posexplode_outer(D.promoted_spans(F.col("hot_spans"))).alias("place", "s")).where("s is not null")
    return shown(d.select("doc_id", "place", "s.*"), "doc_id", "place", "start", "end", "score")


@query
def prose_chunks(spark, sf_dir):
    """Chunks of 300 characters at most of texts with a paragraph for each sentence."""
    block = F.regexp_replace("text", "([.!?]) ", "$1\n\n")
    d = read(spark, sf_dir, "documents").select("doc_id", T.prose_chunks(block, 300).alias("c"))
    longest = F.coalesce(F.array_max(F.transform("c", F.length)), F.lit(0))
    return shown(d.select("doc_id", F.size("c").alias("n_chunks"), longest.alias("longest"), F.md5(F.array_join("c", "|")).alias("digest")), "doc_id", "n_chunks", "longest", "digest")


@query
def protected_offsets(spark, sf_dir):
    """Where URLs and addresses stand in texts of which every fourth has some that touch."""
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" https://a.example/x?y=jo@b.example and q@c.example "))).otherwise(F.col("text"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.protected_offsets(text)).alias("s")).select("doc_id", "s.*")
    return shown(d, "doc_id", "start", "end")


@query
def overlapping_spans(spark, sf_dir):
    spans = F.expr("array(named_struct('start', 10, 'end', 20), named_struct('start', 30, 'end', 31))")
    at = (F.col("doc_id") % 50).cast("int")
    return read(spark, sf_dir, "documents").select("doc_id", T.overlaps(at, at + 3, spans).alias("hit"))


@query
def finite_units(spark, sf_dir):
    x = F.expr("case doc_id % 4 when 0 then double('NaN') when 1 then double('-Infinity') else n_chars / 1000D - 0.5D end")
    return shown(read(spark, sf_dir, "documents").withColumn("unit", M.finite_unit(x, 0.25)), "doc_id", "unit")


@query
def matched_casing(spark, sf_dir):
    """A word in the casing of each document's words, of which every third document's are capitals."""
    d = words_cased(spark, sf_dir).select("doc_id", T.match_casing(F.col("w"), F.lit("éxample")).alias("word"))
    return d.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def words_cased(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(T.words(text)).alias("w"))


@query
def joined_sentences(spark, sf_dir):
    lines = F.split("text", "[,;] ")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.join_sentences(lines)).alias("digest"), F.length(T.join_sentences(lines)).cast("long").alias("chars"))


@query
def outer_space(spark, sf_dir):
    around = F.concat(F.lit(" \n\t"), "text", F.lit("\n "))
    return read(spark, sf_dir, "documents").select("doc_id", markdown.keep_outer_space(around, F.lit("  new ")).alias("text"))


@query
def image_provenance(spark, sf_dir):
    """What image files made of the documents carry, and the packets or comments read back by their ranges."""
    d = read(spark, sf_dir, "documents").select("doc_id", made_files.image_of(F.col("doc_id") % 4, made_files.packet(F.col("text"))).alias("content"))
    found = F.col("embedded.found")
    carried = F.filter(found, lambda f: f["kind"].isin("xmp", "comment"))
    cut = F.transform(carried, lambda f: F.hex(F.substring(F.col("content"), f["start"].cast("int") + 1, (f["end"] - f["start"]).cast("int"))))
    d = embedded.audit(d).select(
        "doc_id", F.col("embedded.format").alias("format"), F.array_join(F.transform(found, lambda f: f["kind"]), ",").alias("kinds"),
        F.array_min(F.transform(carried, lambda f: f["start"])).alias("first_start"), F.array_max(F.transform(carried, lambda f: f["end"])).alias("last_end"),
        F.md5(F.unhex(F.array_join(cut, ""))).alias("digest"), F.col("embedded.error").isNull().alias("whole"),
    )
    return shown(d, "doc_id", "format", "kinds", "first_start", "last_end", "digest", "whole")


@query
def claim_assertions(spark, sf_dir):
    """The content boxes of claim stores in PNG files made of the documents."""
    store = made_files.claim_store(F.col("doc_id"), F.col("text"))
    d = read(spark, sf_dir, "documents").select("doc_id", made_files.png(made_files.png_chunk(b"caBX", store)).alias("content"))
    rows = embedded.assertions(embedded.audit(d), "doc_id")
    rows = rows.select("doc_id", "manifest", "label", "content", "start", (F.col("end") - F.col("start")).alias("size"), F.md5(F.get_json_object("value", "$.text")).alias("digest"))
    return shown(rows, "doc_id", "manifest", "label", "content", "start", "size", "digest")


@query
def pdf_provenance(spark, sf_dir):
    """Information and metadata streams of PDF files made of the documents."""
    d = read(spark, sf_dir, "documents").select("doc_id", made_files.pdf_of(F.col("doc_id"), made_files.packet(F.col("text"))).alias("content"))
    rows = embedded.audit(d).select("doc_id", "content", F.col("embedded.error").isNull().alias("whole"), F.explode("embedded.found").alias("f")).select("doc_id", "content", "whole", "f.*")
    cut = F.substring("content", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return shown(rows.withColumn("digest", F.md5(cut)), "doc_id", "kind", "name", "value", "start", "end", "digest", "whole")


@query
def suffix_kinds(spark, sf_dir):
    ends = F.expr("array('.HTML', '.png', '.pdf', '.md', '.tar.gz', '')")
    path = F.concat(F.lit("s3a://b/d.x/"), F.col("page_id").cast("string"), F.get(ends, (F.col("page_id") % 6).cast("int")))
    d = read(spark, sf_dir, "pages").select("page_id", provenance.suffix_kind(path).alias("kind"), output_name(path, ".out").alias("name"))
    return shown(d, "page_id", "kind", "name")


@query
def event_rates(spark, sf_dir):
    """Events by hour and kind, as the stream's operator counts them."""
    d = stream.event_rates(read(spark, sf_dir, "events"))
    return shown(d.select("start", "event_type", "events", "value"), "start", "event_type", "events", "value")


@query
def streaming_detect(spark, sf_dir):
    """The detectors over documents as a stream, until all files that are there are read."""
    import uuid

    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    source = path if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory() else f"{sf_dir}/documents*.parquet"
    scored = stream.score_stream(stream.read_documents(spark, source, schema), known_ranks(spark, sf_dir))
    stream.run_available(scored, f"{work}/out", f"{work}/checkpoint")
    return shown(spark.read.parquet(f"{work}/out"), "doc_id", "ensemble_score", "ensemble_confidence", "label")


ORACLE_SQL = dict(sql.ORACLE_SQL)
ORACLE_SQL["streaming_detect"] = sql.query([sql.CORPUS_RANKS if p == sql.RANKS else p for p in sql.ENSEMBLE_PARTS], f"SELECT doc_id, {sql.R('ensemble_score', 'ensemble_confidence')}, label FROM lab", "SELECT doc_id, text FROM documents")
