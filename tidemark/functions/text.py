"""Functions on columns of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What parts tokens.
BETWEEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), BETWEEN), lambda t: t != "")


def kind_of_line(text: Column) -> Column:
    """What a line could be on the screen: a ``card`` (a name, a colon and more), a ``punch`` (at most 3 words), a ``point`` (at most 12), or ``prose``."""
    n = F.size(tokens(text))
    return F.when(text.rlike(r"^[^:]{1,40}: \S"), "card").when(n <= 3, "punch").when(n <= 12, "point").otherwise("prose")
