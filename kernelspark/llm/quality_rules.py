"""Quality rules as weak voters: each votes good, votes bad or abstains, and the posterior decides.

Instead of dropping a document at its first failed rule, expectation-maximisation over the
votes of all documents estimates how often each rule is right, and a document stays if its
posterior probability of being good reaches ``least``. Votes are plain columns over counts
that one pass over the texts makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_table, read
from .label_model import vote, weigh
from .text_stats import with_stats

LEAST = 0.5


def rules() -> dict[str, Column]:
    """Rule name to its vote. Limits are shares of words, lines or letters; between the limits a rule abstains."""
    words, lines, chars = F.col("n_words"), F.col("n_lines"), F.greatest(F.col("word_chars"), F.lit(1))
    mean = F.col("word_chars") / F.greatest(words, F.lit(1))
    return {
        "length": vote(words >= 50, words < 20),
        "word_length": vote((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 15)),
        "symbols": vote(10 * F.col("n_symbols") <= words, 4 * F.col("n_symbols") > words),
        "dup_lines": vote(20 * F.col("n_dup_lines") <= lines, 10 * F.col("n_dup_lines") > 3 * lines),
        "repeats": vote(20 * F.col("n_repeat_words") <= words, 5 * F.col("n_repeat_words") > words),
        "variety": vote(5 * F.col("n_distinct_words") >= words, 12 * F.col("n_distinct_words") < words),
        "capitals": vote(5 * F.col("n_upper") <= chars, 2 * F.col("n_upper") > chars),
        "digits": vote(20 * F.col("n_digits") <= chars, 5 * F.col("n_digits") > chars),
        "plain_words": vote(10 * F.col("n_plain_words") >= 7 * words, 2 * F.col("n_plain_words") < words),
        "sentences": vote((F.col("n_ends") * 60 >= words) & (F.col("n_ends") * 2 <= words), F.col("n_ends") * 300 < words),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs without the text, with its counts, base_failed, quality (posterior) and kept.

    A null or empty text has no words and fails the base rules. Repeated rows vote one by
    one; an empty table gives an empty result. Clashing column names raise ValueError.
    """
    if clash := {"base_failed", "quality", "kept"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    counted = checkpoint_table(with_stats(docs, text), docs.sparkSession, "rules-counts")
    weighed = weigh(counted, rules(), "quality").withColumn("base_failed", base_failed())
    return weighed.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
