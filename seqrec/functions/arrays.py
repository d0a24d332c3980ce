"""Scalar and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seqrec.config import ITEM_PAD, NEGATIVE, NEUTRAL, POSITIVE, TOKEN_BOS, TOKEN_OFFSET


def feedback(rating: Column, positive: float, neutral: float) -> Column:
    """3, 2 or 1 by rating; null and NaN are negative, unlike in SQL's order, where NaN is greatest."""
    return F.when(rating.isNull() | F.isnan(rating), NEGATIVE).when(rating >= positive, POSITIVE).when(rating >= neutral, NEUTRAL).otherwise(NEGATIVE)


def or_empty(ids: Column, kind: str = "array<bigint>") -> Column:
    return F.coalesce(ids, F.array().cast(kind))


def last(ids: Column, n: int) -> Column:
    """The last ``n`` elements (all, if fewer)."""
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))


def checked_feedback(ids: Column) -> Column:
    ids = or_empty(ids)
    return F.when(F.forall(ids, lambda x: x.between(NEGATIVE, POSITIVE)), ids).otherwise(F.raise_error(F.lit("a feedback id is not 1, 2 or 3")))


def padded(ids: Column, length: int) -> Column:
    room = F.lit(length) - F.size(ids)
    return F.when(room >= 0, F.concat(ids, F.array_repeat(F.lit(ITEM_PAD).cast("bigint"), room))).otherwise(F.raise_error(F.lit("a history is longer than the fixed length")))


def padding_mask(ids: Column, length: int) -> Column:
    """True at padding."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i > F.size(ids))


def shifted(target: Column) -> Column:
    """The decoder's input: BOS and the target without its last token."""
    return F.concat(F.array(F.lit(TOKEN_BOS)), F.slice(target, F.lit(1), F.size(target) - 1))


def target_tokens(code: Column) -> Column:
    return F.transform(code, lambda x: x + TOKEN_OFFSET)


_GOLDEN, _SIGN = 11400714819323198485, 14029467366897019727
_M64 = 18446744073709551616


def bucket(item: Column, components: int, seed: int) -> Column:
    """(item * odd constant + seed constant) mod 2^64, mod components, in exact decimals."""
    product = item.cast("decimal(18,0)") * F.lit(str(_GOLDEN)).cast("decimal(20,0)")
    total = product.cast("decimal(38,0)") + F.lit(str(seed + 0x9E3779B1)).cast("decimal(12,0)")
    return ((total % F.lit(str(_M64)).cast("decimal(20,0)")) % F.lit(components)).cast("int")


def sign(item: Column, seed: int) -> Column:
    """+1 or -1 by the lowest bit of (item * odd constant + seed constant) mod 2^64."""
    return F.when((item.bitwiseAND(F.lit(1)).bitwiseXOR(F.lit((seed + 0x85EBCA6B) & 1))) == 0, 1.0).otherwise(-1.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """``v`` scaled to length 1; a zero vector is unchanged."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def log_softmax(v: Column) -> Column:
    z = log_sum_exp(v)
    return F.transform(v, lambda x: x - z)


def joined(ids: Column) -> Column:
    """An array as text, for output."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
