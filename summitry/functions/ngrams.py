"""Character n-grams and Dice similarity of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the trigram and bigram parts of the string distance.
TRIGRAM, BIGRAM = 0.9, 0.1


def grams(text: Column, n: int) -> Column:
    """The n-grams of a string in order, with repeats; none if it is shorter."""
    count = F.char_length(text) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def numbered(values: Column) -> Column:
    """Each value with the number of its earlier equals, so that sets count repeats."""
    return F.transform(values, lambda x, i: F.concat_ws("\u0001", x, F.size(F.filter(F.slice(values, F.lit(1), i), lambda y: y == x)).cast("string")))


def dice(a: Column, b: Column, n: int) -> Column:
    """2 |A n B| / (|A| + |B|) over multisets of n-grams; 0 where one is empty."""
    x, y = numbered(grams(a, n)), numbered(grams(b, n))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)


def string_dice(a: Column, b: Column) -> Column:
    return TRIGRAM * (1 - dice(a, b, 3)) + BIGRAM * (1 - dice(a, b, 2))


def gram_counts(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, gram, n) for joins on the gram."""
    return df.select(F.col(id_col).alias("id"), F.explode(grams(F.col(text_col), n)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))


def dice_join(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(a, b, dice) of all pairs with a gram in common, by an equi-join on grams."""
    counts = gram_counts(df, id_col, text_col, n)
    sizes = counts.groupBy("id").agg(F.sum("n").alias("size"))
    left, right = counts.toDF("a", "gram", "na"), counts.toDF("b", "gram", "nb")
    both = left.join(right, "gram").where("a < b").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("both"))
    return both.join(sizes.toDF("a", "sa"), "a").join(sizes.toDF("b", "sb"), "b").select("a", "b", (2.0 * F.col("both") / (F.col("sa") + F.col("sb"))).alias("dice"))
