"""Word lists and constants of the detectors. Longer lists come as parameters: see word_ranks()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# These must be as they are for the scores to be the expected ones.
EXPECTED_SHARE = {
    "the": 0.070, "be": 0.025, "to": 0.026, "of": 0.025, "and": 0.027, "a": 0.023, "in": 0.018, "that": 0.012,
    "it": 0.011, "for": 0.010, "on": 0.007, "with": 0.007, "as": 0.006, "by": 0.005, "this": 0.005, "but": 0.004,
    "from": 0.004, "or": 0.004, "an": 0.004, "not": 0.006,
}
FUNCTION_WORDS = tuple(
    """
    a an the and or but if while although because as than that this these those
    i you he she it we they me him her us them my your his its our their mine
    yours ours theirs myself yourself himself herself itself ourselves
    is am are was were be been being do does did have has had having
    can could may might must shall should will would
    of in on at to for from by with without into onto over under about
    between among through during before after against toward towards
    not no nor never none nothing nobody
    what which who whom whose where when why how
    so such too very just only even also still yet already
    there here then than once
    """.split()
)
RARE_FUNCTION_WORDS = ("yet", "nor")
STOCK_PHRASES = (
    "in conclusion", "in summary", "to summarize", "it is important to note that", "it's important to note that",
    "it is worth noting that", "it is crucial to", "plays a crucial role", "plays a vital role",
    "plays a significant role", "in today's world", "in today's digital age", "in today's rapidly evolving",
    "delve into", "delve deeper", "dive into", "a wide range of", "a plethora of", "a myriad of", "testament to",
    "highlights the importance", "serves as a reminder", "it should be noted that", "needless to say",
    "when it comes to", "at the end of the day", "in order to", "due to the fact that", "in the event that",
    "a significant number of", "the vast majority of", "on the other hand", "first and foremost",
    "last but not least", "in this article", "this article will", "this blog post", "let's explore", "let us explore",
    "let's dive in", "without further ado", "moving forward", "as previously mentioned", "as mentioned earlier",
    "it goes without saying", "the fact that", "in terms of", "with regard to", "with respect to", "in light of",
    "based on the above", "taking into account", "from a broader perspective", "it is widely believed",
    "studies have shown", "research suggests that", "experts agree that", "one of the most important",
    "a key aspect of", "a key component of", "the key takeaway", "the bottom line is",
)
OPENERS = (
    "in today's", "in conclusion", "in summary", "this article", "this comprehensive", "in the ever-evolving",
    "in the rapidly", "in a world where", "when it comes to", "it is important", "it's important",
    "first and foremost", "let's delve", "let's dive", "imagine a world", "picture this",
)
STOCK_WORDS = (
    "delve|leverage|utilize|robust|comprehensive|cutting[- ]edge|landscape|tapestry|paradigm|holistic|streamline|"
    "empower|harness|groundbreaking|seamless|unlock|foster|optimize|revolutionize|furthermore|moreover|additionally|"
    "consequently|subsequently|testament|underscores|pivotal|multifaceted|plethora|myriad"
)
HEDGES = (
    "it is important to note|it's important to note|in conclusion|in summary|in today's world|in today's digital|"
    "plays a (?:crucial|vital|significant) role|a wide range of|in order to|due to the fact that|"
    "at the end of the day|when it comes to|needless to say|first and foremost|last but not least"
)
#: Plain substitutes of some stock phrases, for perturbation; other tables are parameters.
PHRASE_SWAPS = {
    "in conclusion": ["to close", "at the end"], "in summary": ["in brief"], "it is important to note that": ["note that", "bear in mind that"],
    "in today's world": ["today", "nowadays"], "delve into": ["examine", "study"], "a wide range of": ["many", "various"], "a wide": ["a broad"],
    "in order to": ["to"], "due to the fact that": ["because"], "when it comes to": ["regarding"], "leverage": ["use"], "robust": ["strong", "sound"],
    "this article will": ["here we"], "landscape": ["field"], "the landscape": ["the field"], "in terms of": ["as to"],
}
GREEN_SEEDS = (3, 7, 13, 17, 29, 41, 53, 97, 193, 389, 769, 1543)
FAMILY_WEIGHTS = {"classical": 0.34, "stylometric": 0.28, "watermark": 0.30}
COMMON_RANK, VERY_COMMON_RANK = 250, 80

#: So many words of a corpus have a rank.
RANKED_WORDS = 370


def word_ranks(tokens: DataFrame, limit: int = RANKED_WORDS) -> DataFrame:
    """word, rank (from 1) of the most frequent words of tokens(tok), by count and then by word. With a column n, a row is n tokens.

    A list of ranks is a parameter of everything that uses one; this is the rule where none is given. The counts are
    partial before the shuffle, and only `limit` rows meet in one task.
    """
    count = F.sum("n") if "n" in tokens.columns else F.count("*")
    top = tokens.groupBy("tok").agg(count.alias("n")).orderBy(F.col("n").desc(), "tok").limit(limit)
    order = Window.orderBy(F.col("n").desc(), "tok")
    return top.select(F.col("tok").alias("word"), F.row_number().over(order).alias("rank"))
