"""Intent tagging of conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Intents = Sequence[tuple[str, Sequence[str]]]

# Intents and the words that give them away; the first hit decides.
DIAGNOSTIC_INTENTS: Intents = (
    ("audit", ("audit", "compliance", "hipaa", "safe harbor")),
    ("failure", ("fail", "error", "crash")),
    ("trace", ("trace", "span")),
    ("latency", ("latency", "performance", "speed", "benchmark")),
    ("schema", ("schema", "tables")),
    ("statistics", ("select", "sql", "cost", "patient")),
)
DEFAULT_INTENT = "recent"


def latest_user_message(messages: DataFrame) -> DataFrame:
    """(conv_id, message): the last user turn of each conversation in lower case, empty where the
    user said nothing. Of several texts at the last turn, the one of the greatest hash counts;
    turns without a number come before all others, and conversations without an id are one.

    Texts stay out of the aggregation, which would have to sort them: first the greatest turn
    and hash of a conversation are found from numbers alone, by hashing, then one lookup brings
    the text they belong to. The numbers are one decimal, turn before hash, so that their
    greatest is of one row.
    """
    # 38 digits hold a turn of 64 bits, null turns below them all, and 18 digits of hash.
    turn = F.coalesce(F.col("turn").cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))
    place = turn * F.lit("1" + "0" * 18).cast("decimal(19,0)") + F.shiftrightunsigned(F.xxhash64("text"), 5)
    by_user = messages.where(F.col("role") == "user").select(
        "conv_id", place.cast("decimal(38,0)").alias("place"), F.coalesce("text", F.lit("")).alias("text")
    )
    last = by_user.groupBy("conv_id").agg(F.max("place").alias("place"))
    found = by_user.alias("m").join(
        last.alias("l"),
        F.col("m.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("m.place") == F.col("l.place")),
        "left_semi",
    )
    # Rows said twice are one message.
    messages_found = found.select("conv_id", F.lower("text").alias("message")).distinct()
    everyone = messages.select("conv_id").distinct()
    return everyone.alias("e").join(
        messages_found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left"
    ).select("e.conv_id", F.coalesce("f.message", F.lit("")).alias("message"))


def intent(message: Column, intents: Intents = DIAGNOSTIC_INTENTS, default: str = DEFAULT_INTENT) -> Column:
    """Label of the first entry of ``intents`` one of whose words the message, which is
    in lower case, contains."""
    label = None
    for name, words in intents:
        hit = F.lit(False)
        for word in words:
            hit = hit | message.contains(word.lower())
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return F.lit(default) if label is None else label.otherwise(default)


def tag_texts(
    texts: DataFrame, column: str, intents: Intents = DIAGNOSTIC_INTENTS, default: str = DEFAULT_INTENT
) -> DataFrame:
    """Adds ``intent`` for a text column. Lower case comes from a projection of its own,
    so that it is made once a row and not once a word."""
    lowered = texts.withColumn("_lowered", F.lower(F.coalesce(F.col(column), F.lit(""))))
    return lowered.withColumn("intent", intent(F.col("_lowered"), intents, default)).drop("_lowered")


def tag_intents(
    messages: DataFrame, intents: Intents = DIAGNOSTIC_INTENTS, default: str = DEFAULT_INTENT
) -> DataFrame:
    """(conv_id, message, intent) from each conversation's latest user message."""
    return latest_user_message(messages).withColumn("intent", intent(F.col("message"), intents, default))
