"""Statistics as column expressions, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of 95% intervals; evaluation scripts use the rounded one.
Z = 1.959963985
Z_ROUNDED = 1.96


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.when(whole > 0, part / whole)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def floor_of_sum(value: Column) -> Column:
    """The floor of a sum of doubles just as they are stored, the same in whatever order rows come; null for no values.

    A sum of doubles may round across a whole number. Here each is cut into whole numbers of 1, 2^-52 and 2^-104, whose
    sums are exact; only what values under 2^-51 have beyond that is added as doubles.
    """
    step, rest, sums = 1 << 52, value.cast("double"), []
    for _ in range(3):
        part = rest.cast("long")
        sums.append(F.sum(part.cast("decimal(20,0)")))
        rest = (rest - part) * float(step)
    over = F.floor(F.sum(rest) / float(step)).cast("decimal(30,0)")
    for total in (sums[2], sums[1]):
        total = total + over
        over = ((total - F.pmod(total, F.lit(step))) / step).cast("decimal(30,0)")
    return (sums[0] + over).cast("long")


def wilson(part: Column, whole: Column, z: float = Z) -> tuple[Column, Column]:
    """Both ends of the Wilson interval, within 0 and 1; null for no trials."""
    n, p = whole.cast("double"), part / whole
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low = F.when(whole > 0, F.greatest(F.lit(0.0), (centre - spread) / scale))
    high = F.when(whole > 0, F.least(F.lit(1.0), (centre + spread) / scale))
    return low, high


def wilson_sql(part: str, whole: str, z: float = Z) -> tuple[str, str]:
    p, n, zz = f"(CAST({part} AS DOUBLE) / {whole})", f"CAST({whole} AS DOUBLE)", f"{z * z!r}::DOUBLE"
    spread = f"{z!r}::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {zz} / (4 * {n} * {n}))"
    return (f"CASE WHEN {whole} > 0 THEN greatest(0.0::DOUBLE, ({p} + {zz} / (2 * {n}) - {spread}) / (1 + {zz} / {n})) END",
            f"CASE WHEN {whole} > 0 THEN least(1.0::DOUBLE, ({p} + {zz} / (2 * {n}) + {spread}) / (1 + {zz} / {n})) END")


def half_width(share: Column, total: Column, z: float = Z_ROUNDED) -> Column:
    """Half the width of the interval around a share of a total."""
    n = total.cast("double")
    return F.when(total > 0, z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / (1 + z * z / n))


def errors_apart(hit_1: Column, of_1: Column, hit_2: Column, of_2: Column) -> Column:
    """How many standard errors the second share lies above the first, pooled; 0 where a side is empty or nothing varies."""
    q = (hit_1 + hit_2) / (of_1 + of_2)
    spread = F.sqrt(q * (1 - q) * (1 / of_1.cast("double") + 1 / of_2.cast("double")))
    z = (hit_2 / of_2 - hit_1 / of_1) / spread
    return F.when((of_1 > 0) & (of_2 > 0) & (hit_1 + hit_2 > 0) & (hit_1 + hit_2 < of_1 + of_2), z).otherwise(F.lit(0.0))


def errors_apart_sql(hit_1: str, of_1: str, hit_2: str, of_2: str) -> str:
    q = f"(CAST({hit_1} + {hit_2} AS DOUBLE) / ({of_1} + {of_2}))"
    return (f"CASE WHEN {of_1} > 0 AND {of_2} > 0 AND {hit_1} + {hit_2} > 0 AND {hit_1} + {hit_2} < {of_1} + {of_2} THEN "
            f"(CAST({hit_2} AS DOUBLE) / {of_2} - CAST({hit_1} AS DOUBLE) / {of_1}) / sqrt({q} * (1 - {q}) * (1.0::DOUBLE / {of_1} + 1.0::DOUBLE / {of_2})) ELSE 0.0::DOUBLE END")


def log_odds(here: Column, of: Column, there: Column, of_other: Column) -> tuple[Column, Column]:
    """The difference of log odds of two shares and its variance, each cell raised by a half."""
    rest = lambda a, b: F.greatest(a - b, F.lit(0))
    a, b, c, d = here + 0.5, rest(of, here) + 0.5, there + 0.5, rest(of_other, there) + 0.5
    return F.ln(a / b) - F.ln(c / d), 1 / a + 1 / b + 1 / c + 1 / d


def nearly(left: Column, right: Column) -> Column:
    """Whether each of two counts is at least nineteen twentieths of the other."""
    return (left * 20 >= right * 19) & (right * 20 >= left * 19)


def corrected(observed: Column, labelled: Column, read: Column, agreed: Column, seen: Column, least: int = 40, gap: float = 0.1) -> Column:
    """A share as it would be without the reader's errors; null with few labels or a reader that hardly tells."""
    fpr, found = ratio_or_zero(read - agreed, seen - labelled), ratio_or_zero(agreed, labelled)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (observed - fpr) / (found - fpr)))
    return F.when((labelled >= least) & (found - fpr > gap), value)


def kappa(agreed: Column, expected: Column) -> Column:
    """Cohen's kappa from the observed and expected agreement; null where it isn't finite."""
    return F.when(expected < 1, (agreed - expected) / (1 - expected))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def quantised(vector: Column) -> tuple[Column, Column]:
    """(scale, whole numbers of -127..127): rounded half away from zero; a zero vector has scale 1."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, 127 / top).otherwise(F.lit(1.0))
    cells = F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), (F.signum(x.cast("double")) * F.floor(F.abs(x.cast("double") * scale) + 0.5)).cast("int"))).cast("tinyint"))
    return scale, cells
