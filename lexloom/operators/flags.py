"""Token flags from neighbouring punctuation and case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import case_code

QUOTES = ('"', "''", "``")
SEPARATORS = (",", ".", ":", ";", "!", "?", "-", "(", ")", '"', "''", "``", "'", "/", "|")
NAMES = ("first_capital", "all_capital", "dash_after", "quote_before", "quote_after", "paren_before", "paren_after", "separator_after")


def token_flags(toks: DataFrame) -> DataFrame:
    """toks with the eight flags. A quote or parenthesis seen last in the line holds until other punctuation comes."""
    line = Window.partitionBy("sent_id").orderBy("pos")
    next_punc = F.lead(F.when(F.col("is_punc"), F.col("token"))).over(line)
    last_punc = F.last(F.when(F.col("is_punc"), F.col("token")), ignorenulls=True)
    before = last_punc.over(line.rowsBetween(Window.unboundedPreceding, -1))
    at_next = last_punc.over(line.rowsBetween(Window.unboundedPreceding, 0))
    word, code = ~F.col("is_punc"), case_code(F.col("surface"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return toks.withColumns({
        "first_capital": flag(word & code.isin(1, 3)),
        "all_capital": flag(word & (code == 3)),
        "dash_after": flag(next_punc == "-"),
        "quote_before": flag(word & before.isin(*QUOTES)),
        "quote_after": flag(next_punc.isin('"', "''") | (next_punc.isNotNull() & (at_next == "``"))),
        "paren_before": flag(word & (before == "(")),
        "paren_after": flag(next_punc == ")"),
        "separator_after": flag(next_punc.isin(*SEPARATORS)),
    })


def as_bits(*names: str) -> Column:
    """The flags as one integer, the first flag the lowest bit."""
    out = F.lit(0)
    for k, n in enumerate(names or NAMES):
        out = out.bitwiseOR(F.shiftleft(F.col(n).cast("int"), k))
    return out
