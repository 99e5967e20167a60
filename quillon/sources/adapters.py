"""Multiple-choice sources in one shape: (source, key, context, question, options, answer_idx).

Each adapter takes rows with the columns its source publishes, besides a
`_key`, and leaves out rows whose answer names no option.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest

LETTERS = ("A", "B", "C", "D")  # fixed values: the answer keys of reading tests


def _shaped(rows: DataFrame, source: str, context: Column, question: Column, options: Column, answer: Column) -> DataFrame:
    out = rows.select(F.lit(source).alias("source"), F.col("_key").alias("key"), context.alias("context"), question.alias("question"), options.alias("options"), answer.cast("int").alias("answer_idx"))
    return out.where(F.col("answer_idx").between(0, F.size("options") - 1))


def _place(options: Column, wanted: Column) -> Column:
    """The first place of a value, from 0; null where it is not there."""
    return F.nullif(F.array_position(options, wanted), F.lit(0)) - 1


def reading(rows: DataFrame, source: str = "race") -> DataFrame:
    """(article, question, options, answer): a passage, four options and a letter; rows with another number of options go."""
    four = rows.where(F.size("options") == len(LETTERS))
    return _shaped(four, source, F.col("article"), F.col("question"), F.col("options"), _place(F.array(*map(F.lit, LETTERS)), F.col("answer")))


def keyed(rows: DataFrame, source: str, question: str = "question", least: int = 1) -> DataFrame:
    """(question, choices struct<label, text>, answerKey): options with a label each, of which the key names one; `least` options at least."""
    enough = rows.where(F.size("choices.text") >= least)
    return _shaped(enough, source, F.lit(""), F.col(question), F.col("choices.text"), _place(F.col("choices.label"), F.col("answerKey")))


def supported(rows: DataFrame, source: str = "sciq", seed: str = "sciq") -> DataFrame:
    """(support, question, correct_answer, distractor1 to distractor3): a supporting passage, null as empty, and four texts in hashed order."""
    texts = F.array("correct_answer", "distractor1", "distractor2", "distractor3")
    order = F.array_sort(F.transform(texts, lambda t, i: F.struct(digest(seed, F.col("_key"), i).alias("h"), t.alias("t"), i.alias("i"))))
    x = rows.withColumn("_order", order)
    return _shaped(x, source, F.coalesce("support", F.lit("")), F.col("question"), F.transform("_order", lambda s: s["t"]), _place(F.transform("_order", lambda s: s["i"]), F.lit(0)))


def endings(rows: DataFrame, source: str = "hellaswag") -> DataFrame:
    """(ctx, endings, label): a text to go on, and a label that should be the number of an ending; other labels go."""
    return _shaped(rows, source, F.lit(""), F.col("ctx"), F.col("endings"), F.trim("label").try_cast("int"))
