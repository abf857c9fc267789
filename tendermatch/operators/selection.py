"""Exact order statistics by radix selection (A1, A4).

Values become 64-bit integers of the same order: sign, exponent and fraction of
the double, by arithmetic in the JVM. A pass counts, for each column, the next
12 bits of the values whose higher bits are those of a wanted rank; the counts
tell which 12 bits the rank has. The first pass is a histogram of exponents;
when few enough values share the bits found so far, one more pass counts them
as they are. A pass is one scan with 4,096 counters for each column and wanted
prefix, combined in the tasks, so that no value is shuffled or sorted however
many different ones there are, and a value that holds a third of the rows is
one counter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12                # bits of a pass
FEW = 1 << BITS          # values under a prefix that are counted as they are
_FRACTION = 52


def order_key(x: Column) -> Column:
    """A double as a bigint of the same order (-0.0 as 0.0); null stays null. NaN is not allowed."""
    a, guess = F.abs(x), _exponent(F.abs(x))
    return _key(x, a, guess, a / F.pow(F.lit(2.0), guess))


def with_order_key(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with :func:`order_key` of a column, step by step: in one expression the logarithm would be taken for every
    place where it is used."""
    df = df.withColumn("_tm_abs", F.abs(F.col(value)))
    df = df.withColumn("_tm_guess", _exponent(F.col("_tm_abs")))
    df = df.withColumn("_tm_scaled", F.col("_tm_abs") / F.pow(F.lit(2.0), F.col("_tm_guess")))
    return (df.withColumn(name, _key(F.col(value), F.col("_tm_abs"), F.col("_tm_guess"), F.col("_tm_scaled")))
            .drop("_tm_abs", "_tm_guess", "_tm_scaled"))


def _exponent(a: Column) -> Column:
    """The exponent from a logarithm, which may be rounded across a power of two."""
    return F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023))


def _key(x: Column, a: Column, guess: Column, scaled: Column) -> Column:
    e = F.when(scaled >= 2.0, guess + 1).when(scaled < 1.0, guess - 1).otherwise(guess)     # the exponent, mended
    fraction = F.when(scaled >= 2.0, scaled / 2.0).when(scaled < 1.0, scaled * 2.0).otherwise(scaled) - 1.0
    normal = (e + 1023) * F.lit(1 << _FRACTION) + (fraction * float(1 << _FRACTION)).cast("bigint")
    key = (F.when(a == float("inf"), F.lit(2047 << _FRACTION)).when(a < 2.0 ** -1022, (a / 5e-324).cast("bigint")).otherwise(normal))
    return F.when(x < 0, -key).otherwise(key).cast("bigint")


def key_value(key: int) -> float:
    """The double of an order key."""
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


def select_ranks(df: DataFrame, wanted: dict[str, Iterable[int]]) -> dict[tuple[str, int], float]:
    """The values of the given 0-based ranks among the non-null values of double columns of ``df``.

    ``df`` is scanned once for each pass, at most six times; ranks outside a column's values are left out.
    """
    names = [c for c, ranks in wanted.items() if ranks]
    if not names:
        return {}
    values = df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "column", "value")
    return select_weighted_ranks(values.withColumn("cnt", F.lit(1).cast("bigint")), wanted)


def select_weighted_ranks(values: DataFrame, wanted: dict[str, Iterable[int]]) -> dict[tuple[str, int], float]:
    """:func:`select_ranks` over rows ``column, value, cnt``, of which each stands for ``cnt`` equal values."""
    wanted = {c: sorted(set(ranks)) for c, ranks in wanted.items() if ranks}
    if not wanted:
        return {}
    keys = with_order_key(values.where(F.col("value").isNotNull() & F.col("column").isin(list(wanted))).select("column", "value", "cnt"),
                          "value", "key").drop("value")
    # (column, rank): higher bits so far, rank among the values that have them
    at: dict[tuple[str, int], tuple[int, int]] = {(c, r): (0, r) for c, ranks in wanted.items() for r in ranks}
    shift, before = _FRACTION, None
    while at:
        bits = F.shiftright("key", shift) if shift else F.col("key")
        if before is not None:
            open_ = {c: sorted({p for (own, _), (p, _) in at.items() if own == c}) for c in {c for c, _ in at}}
            known = F.create_map(*[x for c, ps in open_.items() for x in (F.lit(c), F.array(*[F.lit(p) for p in ps]))])
            bits = F.when(F.array_contains(known[F.col("column")], F.shiftright("key", before)), bits)    # a filter would make the keys twice
        counts: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for r in keys.groupBy("column", bits.alias("bits")).agg(F.sum("cnt").alias("n")).collect():     # FEW for each wanted prefix at most
            if r.bits is None:                                        # under other prefixes
                continue
            parent = r.bits >> (before - shift) if before is not None else 0
            counts.setdefault((r["column"], parent), []).append((r.bits, r.n))
        for own in counts.values():
            own.sort()
        most, moved = 0, {}
        for (c, rank), (prefix, rest) in at.items():
            for child, n in counts.get((c, prefix), ()):
                if rest < n:
                    moved[c, rank] = (child, rest)
                    most = max(most, n)
                    break
                rest -= n
        at = moved
        if not shift:
            return {k: key_value(key) for k, (key, _) in at.items()}
        before, shift = shift, 0 if most <= FEW else max(0, shift - BITS)
    return {}


def rank_pair(n: int, p: float) -> tuple[int, int, float]:
    """The two ranks between which the quantile ``p`` of ``n`` values lies, and how far (linear interpolation)."""
    pos = (n - 1) * p
    low = int(pos)
    return low, min(low + 1, n - 1) if pos > low else low, pos - low


def quantiles(df: DataFrame, requests: Sequence[tuple[str, float]]) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolated quantiles ``(column, p)`` of the non-null values of double columns."""
    names = sorted({c for c, _ in requests})
    if not names:
        return {}
    n = df.agg(*[F.count(F.col(c)).alias(c) for c in names]).first()
    pairs = {(c, p): rank_pair(n[c], p) for c, p in requests if n[c]}
    found = select_ranks(df, {c: [r for (own, _), x in pairs.items() if own == c for r in x[:2]] for c in names})
    out: dict[tuple[str, float], float | None] = {}
    for c, p in requests:
        out[c, p] = None
        if (c, p) in pairs:
            low, high, part = pairs[c, p]
            out[c, p] = found[c, low] + (found[c, high] - found[c, low]) * part
    return out
