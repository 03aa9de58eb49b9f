"""Labelled perturbation of texts, to test how steady detectors are under small changes.

One pass, seeded, and never in place: every row keeps its text beside the changed one, with the edits, the strategy, the strength and the seed.
There is no loop that looks at scores. Tables of substitutes are parameters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions import maths as M
from ..functions import text as T
from . import edits, markdown, pairs

#: Phrases of a table; its automaton is built once in each worker.
MOST_PHRASES = 100_000
EDITS = "array<struct<start:int,end:int,old:string,new:string>>"
#: A word token: letters, and an apostrophe inside. What lies between words is kept as it is.
WORD = r"(?<![\p{L}\p{Nl}\p{No}])\p{L}[\p{L}\p{Nl}\p{No}]*(?:'[\p{L}\p{Nl}\p{No}]+)?"


def cased_like(source: str, word: str) -> str:
    """word in source's casing: all capitals, a first capital, or as it is."""
    if source == source.upper() != source.lower():
        return word.upper()
    first = source[:1]
    return word[:1].upper() + word[1:] if first == first.upper() != first.lower() else word


def folded(text: str) -> str:
    """The lower-cased text, character by character, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(8)
def _automaton(table: str):
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase, options in json.loads(table).items():
        out.add_word(phrase, (phrase, options))
    out.make_automaton()
    return out


def phrase_edits(text: str, doc: str, blocked: list[int], automaton, seed: int) -> list[tuple[int, int, str, str]]:
    """start, end, old, new of the phrases: leftmost and longest, between what isn't part of a word, outside [start, end) pairs of blocked."""
    low, found = folded(text), []
    joins = lambda c: c.isalnum() or c == "_"
    spans = list(zip(blocked[::2], blocked[1::2], strict=True))
    for last, (phrase, options) in automaton.iter(low):
        start, end = last + 1 - len(phrase), last + 1
        if (start and joins(low[start - 1])) or (end < len(low) and joins(low[end])) or any(start < b and a < end for a, b in spans):
            continue
        found.append((start, -end, options))
    out, at = [], 0
    for start, end, options in sorted(found, key=lambda f: f[:2]):
        if start >= at:
            at = -end
            h = int(md5("\x1f".join((str(seed), doc, str(start), "phrase")).encode()).hexdigest()[:7], 16)
            old = text[start:at]
            out.append((start, at, old, cased_like(old, options[h % len(options)])))
    return out


def applied(text: str, changes: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, new in changes:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def perturb_phrases(docs: DataFrame, table: dict[str, list[str]], *, id_col: str = "doc_id", text_col: str = "text", seed: int = 13) -> DataFrame:
    """docs with perturbed, edits (EDITS, by the original's offsets), n_edits, strategy, strength and seed.

    Every phrase of the table (lower-cased phrase -> its substitutes) is replaced, in any casing, by the substitute that a hash of the
    document's id and the place chooses, in the original's casing; none that touches a URL or an address. All phrases are looked for in one
    pass by an Aho-Corasick automaton. Null texts stay null without edits; nothing is shuffled.
    """
    clean = {folded(k): list(v) for k, v in table.items() if k and v}
    if len(clean) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    frozen = json.dumps(clean, sort_keys=True)

    @F.pandas_udf(f"struct<perturbed:string,edits:{EDITS}>")
    def run(texts: pd.Series, ids: pd.Series, blocked: pd.Series) -> pd.DataFrame:
        out, none = [], json.loads(frozen) == {}
        for text, doc, spans in zip(texts, ids, blocked, strict=True):
            if text is None or none:
                out.append((text, []))
                continue
            changes = phrase_edits(text, doc, [int(x) for x in spans], _automaton(frozen), seed)
            out.append((applied(text, changes), [dict(zip(("start", "end", "old", "new"), c, strict=True)) for c in changes]))
        return pd.DataFrame(out, columns=["perturbed", "edits"])

    text = F.col(text_col)
    offsets = F.flatten(F.transform(T.protected_offsets(text), lambda s: F.array(s["start"], s["end"])))
    blocked = F.when(text.contains("@") | F.lower(text).contains("http"), offsets).otherwise(F.array().cast("array<int>"))
    done = docs.withColumn("__p", run(text, F.coalesce(F.col(id_col).cast("string"), F.lit("")), blocked))
    return done.withColumns(
        {"perturbed": F.col("__p.perturbed"), "edits": F.col("__p.edits"), "n_edits": F.size("__p.edits").cast("long"),
         "strategy": F.lit("phrases"), "strength": F.lit(1.0), "seed": F.lit(seed)}
    ).drop("__p")


def restored(perturbed: Column, changes: Column) -> Column:
    """The original, from the changed text and the edits: what was put in is taken out again."""

    def back(a: Column, e: Column) -> Column:
        start = e["start"] + a["shift"]
        keep = F.substr(perturbed, a["at"] + 1, start - a["at"])
        return F.struct(
            F.concat(a["out"], keep, e["old"]).alias("out"), (start + F.length(e["new"])).alias("at"),
            (a["shift"] + F.length(e["new"]) - F.length(e["old"])).alias("shift"),
        )

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("shift"))
    return F.aggregate(changes, first, back, lambda a: F.concat(a["out"], F.substr(perturbed, a["at"] + 1)))


def word_pieces(text: Column) -> Column:
    """The text as structs of gap, own (a word), tail: what is before each word, and what is behind the last; end to end they are the text."""
    text = F.coalesce(text, F.lit(""))

    def laid(both: Column) -> Column:
        toks, gaps = both["toks"], both["gaps"]
        n = F.size(toks)
        return F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: F.struct(gaps[i].alias("gap"), F.get(toks, i).alias("own"), F.when(i == n - 1, gaps[n]).otherwise("").alias("tail")),
        )

    return T.let(F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("toks"), F.split(text, WORD, -1).alias("gaps")), laid)


def perturb_words(
    docs: DataFrame, ranks: DataFrame, table: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", strength: float = 0.42, seed: int = 13
) -> DataFrame:
    """id, text, perturbed, edits (EDITS), n_edits, strategy, strength, seed.

    Of the words that edit targeting picks (edits.placed) those in table (word, options: an array) are replaced with a chance of 0.45 + 0.35 strength; a
    hash of id and place decides, and chooses the substitute, which takes the original's casing. Words go with what is before them, so both
    texts are put together again without loss, from one shuffle by document. Rows of one id are texts of their own; null texts stay null.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).withColumn("__row", F.monotonically_increasing_id())
    rows = rows.select("__row", "__id", F.col("__text").isNull().alias("__null"), F.posexplode(word_pieces(F.col("__text"))).alias("pos", "piece"))
    rows = rows.select("__row", "__id", "__null", (F.col("pos") + 1).alias("pos"), "piece.*").withColumn("tok", F.lower("own"))
    ranked = edits.priorities(rows, ranks, "__row").withColumn("priority", F.round("priority", 6))
    # A word's end in the text is the sum of what is laid down up to it; the window is sorted as that of the priorities is.
    laid = F.length("gap") + F.coalesce(F.length("own"), F.lit(0))
    ranked = ranked.withColumn("end", F.sum(laid).over(Window.partitionBy("__row").orderBy("pos")).cast("int"))
    placed = edits.placed(ranked, strength, "__row")
    options = table.groupBy("word").agg(F.min("options").alias("options")).withColumnRenamed("word", "__word")
    met = placed.join(options, F.col("tok") == F.col("__word"), "left")
    parts = [F.coalesce(F.col("__id").cast("string"), F.lit("")), F.col("pos").cast("string")]
    chosen = F.get("options", (M.keyed_hash([*parts, F.lit("choice")], seed) % F.greatest(F.size("options"), F.lit(1))).cast("int"))
    able = F.expr(edits.TARGETED) & (M.uniform([*parts, F.lit("keep")], seed) >= F.lit(0.55 - 0.35 * strength)) & (F.lower(chosen) != F.col("tok"))
    met = met.withColumn("new", F.when(able, T.match_casing(F.col("own"), chosen)))
    piece = F.struct("pos", "gap", "own", "new", "tail", "end")
    whole = met.groupBy("__row").agg(F.first("__id").alias(id_col), F.first("__null").alias("__null"), F.array_sort(F.collect_list(piece)).alias("pieces"))

    def built(word) -> Column:
        parts = F.transform("pieces", lambda p: F.concat(p["gap"], F.coalesce(word(p), F.lit("")), p["tail"]))
        return F.when(~F.col("__null"), F.array_join(parts, ""))

    edit = lambda p: F.struct((p["end"] - F.length(p["own"])).alias("start"), p["end"].alias("end"), p["own"].alias("old"), p["new"].alias("new"))
    changed = F.filter("pieces", lambda p: p["new"].isNotNull())
    return whole.select(
        id_col, built(lambda p: p["own"]).alias(text_col), built(lambda p: F.coalesce(p["new"], p["own"])).alias("perturbed"),
        F.transform(changed, edit).cast(EDITS).alias("edits"), F.size(changed).cast("long").alias("n_edits"),
        F.lit("words").alias("strategy"), F.lit(float(strength)).alias("strength"), F.lit(seed).alias("seed"),
    )


def steadiness(perturbed: DataFrame, score, text_col: str = "text") -> DataFrame:
    """perturbed rows with score_before, score_after and moved: what score (DataFrame with `text` -> with `score`) says of both texts.

    Both texts of a row are scored in one call, by rows that carry which one they are.
    """
    rows = perturbed.withColumn("__row", F.monotonically_increasing_id())
    both = rows.select(*rows.columns, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(text_col).alias("t")), F.struct(F.lit(1).alias("side"), F.col("perturbed").alias("t")))).alias("__s"))
    scored = score(both.withColumn("__kept", F.col(text_col)).withColumn(text_col, F.col("__s.t")))
    kept = [c for c in perturbed.columns if c != text_col]
    side = lambda k: F.max(F.when(F.col("__s.side") == k, F.col("score")))
    firsts = [F.first(c).alias(c) for c in kept]
    out = scored.groupBy("__row").agg(F.first("__kept").alias(text_col), *firsts, side(0).alias("score_before"), side(1).alias("score_after"))
    return out.drop("__row").withColumn("moved", F.col("score_after") - F.col("score_before"))


def phrase_pattern(phrases: list[str]) -> str:
    """An RE2 pattern of phrases, the longer first, for comparison with SQL."""
    return r"\b(?:" + "|".join(re.escape(p).replace(r"\ ", " ").replace(r"\-", "-") for p in sorted(phrases, key=lambda p: (-len(p), p))) + r")\b"


def guarded(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """f, from a text to a text, as a column function by Arrow batches; null where f fails, so that one bad text stops nothing."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                new = None if t is None else f(t)
                out.append(new if isinstance(new, str) else None)
            except Exception:  # noqa: BLE001  (whatever a caller's function raises leaves the text as it is)
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


def apply_to_markdown(
    docs: DataFrame, change: Callable[[Column], Column], *, id_col: str = "doc_id", text_col: str = "text", limit: int = 3500, protect_tables: bool = True
) -> DataFrame:
    """id, text, perturbed, n_chunks, n_failed, n_edits, strategy: markdown whose prose alone goes through `change`, chunk by chunk.

    Prose, list items and quotations are cut into chunks of paragraphs (text.prose_chunks); each, with its outer white space kept, is replaced by
    what `change` makes of it, or stays where that is null. All else stays as it is, so with an identity the text comes back whole. Ids must be
    unique; null and empty texts stay. Chunks are rows of their own, so a long document is spread until it is put together again.
    """
    segs = markdown.segments(docs.where(F.col(id_col).isNotNull()), id_col, text_col, protect_tables)
    open_ = ~F.col("protected") & F.col("kind").isin(*markdown.REWRITEABLE) & (T.strip(F.col("text")) != "")
    parts = F.when(open_, T.prose_chunks(F.col("text"), limit)).otherwise(F.array("text"))
    rows = segs.select(id_col, "seg", open_.alias("open"), F.posexplode(parts).alias("chunk", "old"))
    rows = rows.withColumn("open", F.col("open") & (T.strip(F.col("old")) != "")).withColumn("made", F.when(F.col("open"), change(F.col("old"))))
    new = F.when(F.col("made").isNotNull(), markdown.keep_outer_space(F.col("old"), F.col("made"))).otherwise(F.col("old"))
    rows = rows.withColumn("new", new)
    count = lambda c: F.sum(c.cast("long"))
    whole = rows.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "chunk", "new"))), lambda x: x["new"]), "").alias("__new"),
        count(F.col("open")).alias("n_chunks"), count(F.col("open") & F.col("made").isNull()).alias("n_failed"), count(F.col("new") != F.col("old")).alias("n_edits"),
    )
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select(id_col, text_col).join(whole, id_col, "left").select(
        id_col, text_col, F.coalesce("__new", text_col).alias("perturbed"), none("n_chunks"), none("n_failed"), none("n_edits"), F.lit("markdown").alias("strategy")
    )


@dataclass(frozen=True)
class Step:
    """A step of a stack: change adds `perturbed` and `n_edits` to rows that have `text` and `doc_id` and keeps their other columns. soft lowers the gate's floor."""

    name: str
    change: Callable[[DataFrame], DataFrame]
    soft: bool = False


def phrases_step(table: dict[str, list[str]], seed: int = 13) -> Step:
    return Step("phrases", lambda d: perturb_phrases(d, table, seed=seed).drop("edits", "strategy", "strength", "seed"), soft=True)


def column_step(name: str, change: Callable[[Column], Column], soft: bool = False) -> Step:
    """A step by a column function; where it gives null the text stays."""

    def run(d: DataFrame) -> DataFrame:
        new = d.withColumn("perturbed", F.coalesce(change(F.col("text")), "text"))
        return new.withColumn("n_edits", F.when(F.col("perturbed") != F.col("text"), 1).otherwise(0).cast("long"))

    return Step(name, run, soft)


#: What a soft step's floor of similarity is to the gate's.
SOFT = 0.70


def perturb_stack(docs: DataFrame, steps: list[Step], settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """id, text, perturbed, n_edits, strategy, notes: the steps one after the other, each held against the original by the quality gate.

    A step that changes nothing, or whose text the gate rejects (any reason but similarity, or similarity under the step's floor), leaves no trace
    but a note; the next one starts from the last text that passed. Everything is made in the row: nothing is shuffled. Null texts stay null.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__original"), F.col(text_col).alias("text"))
    d = d.withColumns({"__edits": F.lit(0).cast("long"), "__applied": F.array().cast("array<string>"), "__notes": F.array().cast("array<string>")})
    for step in steps:
        # Rows are laid down between steps: else each step's expressions would be written out again wherever the next one uses them.
        d = step.change(pairs.apart(d))
        kept = ["doc_id", "__original", "text", "__edits", "__applied", "__notes"]
        same = F.col("perturbed").eqNullSafe(F.col("text")) | F.col("__original").isNull()
        row = F.struct(*kept, "perturbed", "n_edits", "__same").alias("pair_id")
        d = pairs.apart(pairs.apart(d).withColumn("__same", same))
        changed = lambda c: F.when(~F.col("__same"), F.col(c))  # noqa: E731  (where nothing changed, the gate has nothing to tell)
        told = pairs.compare(d.select(row, changed("__original").alias("original"), changed("perturbed").alias("rewritten")), settings)
        floor = settings.quality.min_similarity * (SOFT if step.soft else 1.0)
        hard = F.array_remove("reasons", "similarity")
        passed = (F.size(hard) == 0) & (F.col("similarity") >= floor)
        told = pairs.apart(told.select("pair_id.*", "reasons", "similarity")).select(*kept, "perturbed", "n_edits", "__same", hard.alias("__hard"), passed.alias("__passed"))
        same = F.col("__same")
        take = ~same & F.col("__passed")
        why = F.when(F.size("__hard") > 0, F.array_join("__hard", ",")).otherwise("similarity")
        note = (
            F.when(same, F.lit(f"{step.name}:noop")).when(take, F.concat(F.lit(f"{step.name}:edits="), F.col("n_edits")))
            .otherwise(F.concat(F.lit(f"{step.name}:rejected("), why, F.lit(")")))
        )
        d = told.select(
            "doc_id", "__original", F.when(take, F.col("perturbed")).otherwise(F.col("text")).alias("text"),
            (F.col("__edits") + F.when(take, F.col("n_edits")).otherwise(0)).alias("__edits"),
            F.when(take, F.array_append("__applied", F.lit(step.name))).otherwise(F.col("__applied")).alias("__applied"),
            F.array_append("__notes", note).alias("__notes"),
        )
    strategy = F.when(F.size("__applied") > 0, F.array_join("__applied", "+")).otherwise("identity")
    return d.select(
        F.col("doc_id").alias(id_col), F.col("__original").alias(text_col), F.col("text").alias("perturbed"), F.col("__edits").alias("n_edits"),
        strategy.alias("strategy"), F.col("__notes").alias("notes"),
    )
