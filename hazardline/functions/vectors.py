"""Expressions on ``array<double>`` rows: norms, cosine, and repeatable random corruption.

Randomness is a hash of (seed, salt, row key, position), so a row gets the same draw whatever its
partition, and any other engine with md5 can recompute it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDS = 8  # one md5 (32 hex digits) serves eight positions, four digits each


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Row over its norm; an all-zero row stays zero."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def cosine_similarity(a: Column, b: Column, temperature: float = 1.0) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)) / F.lit(float(temperature))


def _digests(key: Column, length: int, seed: int, salt: str) -> Column:
    blocks = F.sequence(F.lit(0), F.lit((length - 1) // _WORDS))
    return F.transform(blocks, lambda b: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key, b.cast("string"))))


def _hits(digests: Column, i: Column, share: float) -> Column:
    """True for about ``share`` of the positions: four hex digits compared with a fixed limit."""
    if share >= 1.0:
        return F.lit(True)
    limit = format(int(share * 65536), "04x")
    word = F.substring(F.element_at(digests, (F.floor(i / _WORDS) + 1).cast("int")), (i % _WORDS) * 4 + 1, F.lit(4))
    return word < limit


def mask_features_zero(values: Column, key: Column, length: int, share: float, seed: int = 42, salt: str = "m") -> Column:
    """Each value becomes 0 with probability ``share``."""
    digests = _digests(key.cast("string"), length, seed, salt)
    return F.transform(values, lambda x, i: F.when(_hits(digests, i, share), F.lit(0.0)).otherwise(x))


def two_views(values: Column, key: Column, length: int, share: float, seed: int = 42) -> list[Column]:
    """Two independent maskings of one row."""
    return [
        mask_features_zero(values, key, length, share, seed, salt).alias(f"view_{salt}") for salt in ("a", "b")
    ]


def _gauss(key: Column, i: Column, seed: int, salt: str) -> Column:
    """Standard normal draw by Box-Muller from two 32-bit pieces of one digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key, i.cast("string")))

    def piece(start: int) -> Column:
        return (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)

    return F.sqrt(-2.0 * F.log(piece(1))) * F.cos(F.lit(2.0 * math.pi) * piece(9))


def mask_features_noise(
    values: Column, means: Column, key: Column, length: int, share: float, std: float = 0.1, seed: int = 42, salt: str = "n"
) -> Column:
    """Each value becomes column mean + N(0, std) with probability ``share``."""
    text = key.cast("string")
    digests = _digests(text, length, seed, salt)
    return F.transform(
        values,
        lambda x, i: F.when(
            _hits(digests, i, share), F.element_at(means, (i + 1).cast("int")) + std * _gauss(text, i, seed, salt)
        ).otherwise(x),
    )


def perturb_selected(
    values: Column, chosen: list[int], key: Column, std: float = 0.1, seed: int = 42, salt: str = "p"
) -> list[Column]:
    """N(0, std) added at the chosen positions, and the 0/1 mask of those positions."""
    text = key.cast("string")
    picked = [int(c) for c in chosen]

    def inside(i: Column) -> Column:
        return i.isin(picked) if picked else F.lit(False)

    moved = F.transform(values, lambda x, i: F.when(inside(i), x + std * _gauss(text, i, seed, salt)).otherwise(x))
    mask = F.transform(values, lambda x, i: inside(i).cast("double"))
    return [moved.alias("perturbed"), mask.alias("mask")]
