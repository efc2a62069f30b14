"""Ids of what belongs to a document: the document's id and the place in it, in one number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 20
MOST_DOCUMENTS = 1 << 43


def child_id(parent: Column, place: Column) -> Column:
    """``parent * SPAN + place``; a place or a document that would run into another's ids is an error, never a wrong id."""
    wrong = (place >= SPAN) | (place < 0) | (parent >= MOST_DOCUMENTS) | (parent <= -MOST_DOCUMENTS)
    message = F.concat(F.lit("no id left: document "), parent.cast("string"), F.lit(", place "), place.cast("string"))
    return F.when(wrong, F.raise_error(message).cast("long")).otherwise(parent.cast("long") * SPAN + place)


def parent_id(child: Column | str) -> Column:
    child = F.col(child) if isinstance(child, str) else child
    return F.shiftright(child, SPAN.bit_length() - 1)
