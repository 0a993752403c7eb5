"""Labels, tokens and lengths as they come in corpora."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
LETTERS = {"N": 0, "A": 1, "C": 2, "G": 3, "T": 4}


def parse_labels(text: Column) -> Column:
    """Digits: one label each; letters: by the alphabet, unknown ones 0; null: none."""
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    named = F.create_map(*[F.lit(v) for pair in LETTERS.items() for v in pair])
    digits = F.transform(letters, lambda x: x.try_cast("int"))
    by_name = F.transform(letters, lambda x: F.coalesce(named[F.upper(x)], F.lit(0)))
    return F.when(text.isNull(), F.array().cast("array<int>")).when(text.rlike("^[0-9]*$"), digits).otherwise(by_name)


def join_tokens(tokens: Column) -> Column:
    """A list of tokens as one text; null: empty."""
    return F.coalesce(F.array_join(tokens, ""), F.lit(""))


def resolve_length(given: Column, mask: Column, width: Column) -> Column:
    """The given length, else the mask's sum, else the width; never above the width.  A negative one is an error."""
    n = F.coalesce(given, F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x), width)
    return F.when(n < 0, F.raise_error(F.lit("negative length"))).otherwise(F.least(n, width))


def coverage(decoded: Column, steps: Column, ref: Column) -> tuple[Column, Column]:
    """Decoded bases over reference bases (one at least), and the share of steps without a base, 0 at least.

    No more bases count than there are steps; without steps nothing is decoded and all is blank.
    """
    decoded = F.greatest(F.lit(0), F.least(decoded, steps))
    return decoded / F.greatest(ref, F.lit(1)), F.greatest(F.lit(0.0), 1 - F.when(steps > 0, F.try_divide(decoded, steps)).otherwise(0.0))
