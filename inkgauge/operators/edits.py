"""Edit targeting: which words of a text an edit would change first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lexicon
from ..functions import maths as M


def priorities(tokens: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """tokens(id, pos, tok) -> also rank, hint, prior (raised behind an open choice) and priority.

    ranks is a few hundred rows by its definition and is broadcast.
    """
    w = Window.partitionBy(id_col).orderBy("pos")
    d = tokens.join(F.broadcast(ranks), tokens["tok"] == ranks["word"], "left").drop("word").withColumn("hint", M.entropy_hint(F.col("tok"), F.col("rank")))
    raised = F.when(F.lag("hint").over(w) > 0.6, F.least(F.lit(1.0), F.col("hint") + 0.08)).otherwise(F.col("hint"))
    factor = (
        F.when(F.col("tok").isin(*lexicon.FUNCTION_WORDS), 0.15).when(F.col("rank") <= lexicon.VERY_COMMON_RANK, 0.35)
        .when(F.length("tok") < 4, 0.25).otherwise(1.0)
    )
    return d.withColumn("prior", raised).withColumn("priority", F.col("prior") * factor)


#: Which of placed() are targets.
TARGETED = "priority >= 0.25 and place <= most"


def placed(ranked: DataFrame, strength: float = 0.42, id_col: str = "doc_id") -> DataFrame:
    """All words with their place by priority, and most: max(1, round(words (0.1 + 0.5 strength)))."""
    per = Window.partitionBy(id_col)
    place = F.row_number().over(per.orderBy(F.col("priority").desc(), "pos"))
    most = F.greatest(F.lit(1), F.bround(F.count("*").over(per) * F.lit(0.10 + 0.50 * strength)).cast("int"))
    return ranked.withColumn("most", most).withColumn("place", place)


def targets(ranked: DataFrame, strength: float = 0.42, id_col: str = "doc_id") -> DataFrame:
    """Of the words with a priority of 0.25 or more the first max(1, round(words (0.1 + 0.5 strength)))."""
    return placed(ranked, strength, id_col).where(TARGETED).drop("most")
