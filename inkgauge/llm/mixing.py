"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the corpus by its weight. A share may not exceed `max_epochs` times the source's
size: sources above it are clamped there and what they leave is dealt to the others by weight, until none is
above. A source is then taken whole as often as its target allows, and for the fraction that remains a seeded
choice of its documents is taken once more.

The choice is by a hash of the row. For each source a hash limit is found by narrowing a range of hash values
around the wanted number of words, a few bits at a time, so no source is ever gathered in one task: rows below
the limit are taken, and within the last range (about a hundred rows) they are taken in the order of their
hashes as long as they fit.

Defined results: null text counts as empty (size 0, never repeated into words); a null source is a source, last
in the order; an empty table gives no rows; rows alike in id, source and text share one decision; other columns
are kept and, where their names clash with the columns that are added, replaced by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, WORD, global_rank, join_small, text_of, written

HASH_BITS = 62
#: A range of hashes is narrowed until no source has more rows in it.
LAST_RANGE = 128


def source_targets(
    sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0
) -> DataFrame:
    """source, source_size, rows -> those and target. Weights repeat over the sources by code point, null last."""
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "mix-sources")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int"))
    table = written(
        ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "mix-weights"
    )
    first = table.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")
    ).first()
    total, level, clamped = float(first["t"]), (first["t"] / first["w"] if first["w"] else 0.0), -1
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("cap")
        now = table.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("c"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("w"),
        ).first()
        if now["n"] == clamped or not now["w"]:
            break
        clamped, level = now["n"], max(level, (total - now["c"]) / now["w"])
    return table.select(
        "source", "source_size", "rows", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target")
    )


def _limits(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: rows with a hash below `lo`, and those whose hash is in `picked`, are taken once more."""
    state = written(
        targets.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("ratio"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("lo", F.lit(0).cast("long"))
        .withColumn("width", F.lit(HASH_BITS))
        .withColumn("within", F.col("rows")),
        "mix-state",
    )
    few = targets.count() <= BROADCAST_ROWS  # one row for each source; more of them are joined by their hashes
    inside = lambda rows, s: rows.alias("r").join((F.broadcast(s) if few else s).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).where(
        "r.size > 0 and r.u >= s.lo and r.u - s.lo <= shiftleft(1L, s.width) - 1"
    )
    for _ in range(HASH_BITS // 12 + 1):
        most = state.agg(F.max(F.when(F.col("width") > 0, F.col("within")))).first()[0]
        if not most or most <= LAST_RANGE:
            break
        bits = F.least(F.col("width"), F.lit(12), F.greatest(F.lit(0), F.ceil(F.log2(F.col("within") / 64.0)).cast("int")))
        finer = state.withColumn("bits", F.when(F.col("within") > LAST_RANGE, bits).otherwise(0))
        parts = (
            inside(narrow, finer)
            .withColumn("part", F.expr("shiftright(r.u - s.lo, s.width - s.bits)"))
            .groupBy(F.col("s.source").alias("source"), "part")
            .agg(F.sum("r.size").alias("words"), F.count("*").alias("n"))
        )
        # At most 4096 parts for each source.
        upto = F.expr("sum(words) over (partition by source order by part)")
        cut = (
            parts.withColumn("upto", upto)
            .alias("p")
            .join(finer.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
            .where("p.upto > s.left")
            .groupBy(F.col("s.source").alias("source"))
            .agg(F.min(F.struct("p.part", "p.upto", "p.words", "p.n")).alias("c"))
        )
        state = written(
            finer.alias("s")
            .join(cut.alias("c"), F.col("c.source").eqNullSafe(F.col("s.source")), "left")
            .select(
                "s.source", "s.source_size", "s.rows", "s.target", "s.ratio", "s.whole",
                # Without a cut all rows of the range fit: the next range starts behind it and is empty.
                F.expr("case when c.c is null then s.left else s.left - (c.c.upto - c.c.words) end").alias("left"),
                F.expr(
                    "s.lo + case when c.c is null then shiftleft(1L, s.width) - 1 "
                    "else shiftleft(c.c.part, s.width - s.bits) end"
                ).alias("lo"),
                F.expr("case when c.c is null then 0 else s.width - s.bits end").alias("width"),
                F.expr("case when c.c is null then 0 else c.c.n end").alias("within"),
            ),
            "mix-state",
        )
    last = (
        inside(narrow, state)
        .groupBy(F.col("s.source").alias("source"), "r.u", "s.left")
        .agg(F.sum("r.size").alias("words"))
        .groupBy("source", "left")
        .agg(F.sort_array(F.collect_list(F.struct("u", "words"))).alias("rows"))
    )
    picked = last.select(
        "source",
        F.expr(
            "aggregate(rows, named_struct('left', left, 'picked', cast(array() as array<bigint>)), "
            "(a, r) -> if(r.words <= a.left, named_struct('left', a.left - r.words, 'picked', array_append(a.picked, r.u)), a))"
        )["picked"].alias("picked"),
    )
    return (
        state.alias("s")
        .join(picked.alias("p"), F.col("p.source").eqNullSafe(F.col("s.source")), "left")
        .select(
            "s.source", "s.source_size", "s.target", F.col("s.whole").cast("int").alias("whole"), "s.lo",
            F.coalesce(F.col("p.picked"), F.array().cast("array<bigint>")).alias("picked"),
        )
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: float = 3.0,
    seed: int = 13,
) -> DataFrame:
    """docs with size (words), source_size, target (words, its source's), repetitions and taken (words).

    Two passes over the texts, which count words; what else is read is four numbers a row. Sources are joined
    to the rows by join_small, so a hot source is split.
    """
    added = ("size", "source_size", "target", "repetitions", "taken")
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)), 64 - HASH_BITS)
    narrow = written(docs.select(F.col(source_col).alias("source"), u.alias("u"), size.alias("size")), "mix-rows")
    sources = narrow.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("rows")
    )
    limits = _limits(narrow, written(source_targets(sources, weights, max_epochs), "mix-targets")).select(
        F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "whole", "lo", "picked")]
    )
    kept = [c for c in docs.columns if c not in added]
    rows = docs.withColumn("__size", size).withColumn("__u", u).withColumn("__source", F.col(source_col))
    return (
        join_small(rows, limits, ["__source"], "inner")
        .withColumn(
            "__n",
            F.col("__whole")
            + ((F.col("__size") > 0) & ((F.col("__u") < F.col("__lo")) | F.array_contains("__picked", F.col("__u")))).cast("int"),
        )
        .select(
            *kept,
            F.col("__size").alias("size"),
            F.col("__source_size").alias("source_size"),
            F.col("__target").alias("target"),
            F.col("__n").alias("repetitions"),
            (F.col("__n") * F.col("__size")).alias("taken"),
        )
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken; rows that are not taken go."""
    return mixed.where("repetitions > 0").select(*columns, F.explode(F.expr("sequence(1, repetitions)")).alias("__k")).drop("__k")
