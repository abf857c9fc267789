"""Text column expressions (V9) and the offline hashed-token encoder (P5 default).

Token embedding of the offline encoder: hex digit k (k < 8) of md5(token)
maps to (d - 7.5) / 7.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermatch.functions.vectors import bind

# The characters pandas' .str.strip() removes: every code point for which
# Python's str.isspace() holds (29 characters, all below U+3001).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: str | Column, strip: bool = True, lowercase: bool = True, fillna: str = "") -> Column:
    """V9: to string, NULL -> fillna, strip Unicode white space at both ends, lower-case."""
    x = F.coalesce(_c(c).cast("string"), F.lit(fillna))
    if strip:
        x = F.btrim(x, F.lit(WHITESPACE))
    if lowercase:
        x = F.lower(x)
    return x


def tokens(c: str | Column) -> Column:
    """Whole-text white-space tokenisation (no truncation): every white-space
    character becomes a space (``translate``), then split on runs of spaces.
    May yield empty tokens at the ends; ``hashed_embedding`` drops them."""
    return F.split(F.translate(_c(c), WHITESPACE, " " * len(WHITESPACE)), " +")


def token_hash(tok: Column, block: int = 0) -> Column:
    """32 bits for dimensions 8 * block to 8 * block + 7: a quarter of the token's md5, from
    dimension 32 on of the md5 of the token and a running number."""
    text = F.md5(tok) if block < 4 else F.md5(F.concat(tok, F.lit(f"#{block // 4}")))
    return F.conv(F.substring(text, 8 * (block % 4) + 1, 8), 16, 10).cast("long")


def hashed_embedding(df: DataFrame, col: str, dim: int = 8, out: str | None = None) -> DataFrame:
    """Offline encoder: mean of hashed token vectors over the whole text, row by row.

    ``df`` with the vector in ``out`` (default: in place of the text). No key,
    no shuffle: rows stay one to one. A NULL or empty text pools to zeros.
    """
    blocks = range(-(-dim // 8))

    def add(sums: Column, token: Column) -> Column:
        """The sums with the token's digits, each block of the token hashed once."""
        return bind(F.array(*[token_hash(token, b) for b in blocks]), lambda h: F.struct(*[
            (sums[f"s{k}"] + F.shiftright(h[k // 8], 4 * (7 - k % 8)).bitwiseAND(15)).alias(f"s{k}") for k in range(dim)]))

    def pooled(toks: Column) -> Column:
        zero = F.struct(*[F.lit(0).cast("long").alias(f"s{k}") for k in range(dim)])
        n = F.greatest(F.size(toks).cast("double"), F.lit(1e-6))
        return bind(F.aggregate(toks, zero, add), lambda sums: F.array(*[
            (sums[f"s{k}"].cast("double") - F.size(toks) * 7.5) / 7.5 / n for k in range(dim)]))

    toks = F.filter(tokens(F.coalesce(F.col(col), F.lit(""))), lambda t: F.length(t) > 0)
    return df.withColumn(out or col, bind(toks, pooled))
