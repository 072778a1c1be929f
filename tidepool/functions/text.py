"""Column functions of the topic-enrichment query."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the enrichment query: category bounds (exclusive) and labels.
SHORT_BELOW = 10
MEDIUM_BELOW = 30


def text_length(c: Column) -> Column:
    """Length in characters (code points), as INT."""
    return F.char_length(c)


def upper_text(c: Column) -> Column:
    return F.upper(c)


def length_category(c: Column) -> Column:
    """short / medium / long. A NULL message compares as unknown and falls to 'long'."""
    n = F.char_length(c)
    return F.when(n < SHORT_BELOW, "short").when(n < MEDIUM_BELOW, "medium").otherwise("long")


def enrich_columns(message: Column) -> list[Column]:
    """The sink projection: message, message_upper, message_length, category."""
    return [
        message.alias("message"),
        upper_text(message).alias("message_upper"),
        text_length(message).alias("message_length"),
        length_category(message).alias("category"),
    ]
