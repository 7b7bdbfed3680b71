"""Rationale rendering: ordered tokens with mask-1 tokens in brackets.

In-row and linear: each token becomes " tok" / " [tok]", a ``##`` piece
is glued to the previous output token (no space, whatever its mask: the
reference's ``[con]tract`` rule), a leading piece is kept without ``##``.
Then the three spacing clean-ups.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegrain.functions.text import col_of, let


def render_highlight(tokens, mask, mask_offset: int = 1) -> Column:
    """tokens: array<string> without specials; mask: array<int> where token i
    sits at mask position i + mask_offset (1 when position 0 is the start id)."""
    toks = col_of(tokens)

    def build(m):
        def piece(t, i):
            bare = F.regexp_replace(t, r"^##", "")
            flag = F.coalesce(F.element_at(m, i + mask_offset + 1), F.lit(0)) == 1
            word = F.concat(F.lit(" "), F.when(flag, F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare))
            return F.when(t.startswith("##") & (i > 0), bare).otherwise(word)
        return F.array_join(F.transform(toks, piece), "")

    # The mask is bound once per row: a column referenced inside the lambda
    # would be re-evaluated for every token.
    joined = let(col_of(mask), build)
    text = F.regexp_replace(joined, r"^ ", "")
    text = F.regexp_replace(text, r"\s+([.,;:!?])", "$1")
    text = F.regexp_replace(text, r"\[\s+", "[")
    return F.regexp_replace(text, r"\s+\]", "]")


def decode_outcome(label) -> Column:
    """1 → ALLOWED, anything else → DISMISSED."""
    return F.when(col_of(label) == 1, "ALLOWED").otherwise("DISMISSED")
