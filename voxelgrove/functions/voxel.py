"""Row-local expressions: normalisation, nearest label, simplex projection, grey levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(v: Column, lo: float, hi: float) -> Column:
    """0 up to lo, 1 from hi on, linear between."""
    return F.when(v <= lo, 0.0).when(v >= hi, 1.0).otherwise((v - lo) / (hi - lo))


def denormalise(u: Column, lo: float, hi: float) -> Column:
    return F.lit(lo) + F.lit(hi - lo) * u


def doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def check_labels(labels: list[float]) -> list[float]:
    if not 2 <= len(labels) <= 6:
        raise ValueError(f"2 to 6 labels are asked for, not {len(labels)}")
    return [float(x) for x in labels]


def nearest_label(u: Column, labels: list[float]) -> Column:
    """Index of the nearest label; of equally near ones the lowest. Structs sort by distance, then by index."""
    return F.array_min(F.transform(doubles(labels), lambda c, k: F.struct(F.abs(c - u).alias("d"), k.alias("k"))))["k"]


def argmax_label(shares: Column) -> Column:
    """Index of the largest of the shares, the last being what is missing to 1; the first of equal ones."""
    whole = F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))
    return -F.array_max(F.transform(whole, lambda x, k: F.struct(x.alias("x"), (-k).alias("k"))))["k"]


def project_simplex(q: Column, size: int) -> Column:
    """The nearest point with parts of at least 0 that sum to 1."""
    down = F.reverse(F.array_sort(q))
    sums = F.transform(down, lambda x, k: F.struct(x.alias("x"), (k + 1).alias("j"), F.aggregate(F.slice(down, F.lit(1), k + 1), F.lit(0.0), lambda a, y: a + y).alias("s")))
    last = F.element_at(F.filter(sums, lambda t: t["x"] - (t["s"] - 1.0) / t["j"] > 0), -1)
    theta = (last["s"] - 1.0) / last["j"]
    return F.transform(q, lambda x: F.greatest(x - theta, F.lit(0.0)))


def sigmoid(x: Column, lo: float, hi: float) -> Column:
    """Any number into the range lo..hi."""
    return F.lit(hi - lo) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), x)))) + F.lit(lo)


def inverse_sigmoid(r: Column, lo: float, hi: float) -> Column:
    """The number that ``sigmoid`` takes to r; what lies at the ends or beyond is moved inside by a billionth of the range."""
    inside = F.least(F.greatest(r, F.lit(lo + 1e-9 * (hi - lo))), F.lit(hi - 1e-9 * (hi - lo)))
    return -F.log(F.lit(hi - lo) / (inside - F.lit(lo)) - 1)


def pinned_softmax(x: Column) -> Column:
    """Shares of one fixed 0 and the numbers of an array; the largest is taken off first, so that nothing overflows."""
    whole = F.concat(F.array(F.lit(0.0)), x)
    powers = F.transform(whole, lambda a: F.exp(a - F.array_max(whole)))
    return F.transform(powers, lambda a: a / F.aggregate(powers, F.lit(0.0), lambda total, y: total + y))


def project_gaps(x: Column, size: int, gap: float) -> Column:
    """The nearest ``size`` numbers in 0..1 that keep the order of an array's and lie at least ``gap`` apart (equal ones keep their places' order).

    With the gaps taken off the sorted numbers, the nearest ascending ones are means: for each place the greatest, over all beginnings before it, of the least over all ends after it.
    """
    top = max(0.0, 1 - gap * (size - 1))

    def placed(order: Column) -> Column:
        sums = [F.lit(0.0)]
        for k in range(size):
            sums.append(sums[-1] + order[k]["x"] - F.lit(gap * k))
        means = {(a, b): (sums[b + 1] - sums[a]) / (b + 1 - a) for a in range(size) for b in range(a, size)}
        lowest = {(a, k): F.array_min(F.array(*[means[a, b] for b in range(k, size)])) for k in range(size) for a in range(k + 1)}
        level = [F.array_max(F.array(*[lowest[a, k] for a in range(k + 1)])) for k in range(size)]
        inside = [F.least(F.greatest(level[k], F.lit(0.0)), F.lit(top)) + F.lit(gap * k) for k in range(size)]
        return F.array_sort(F.array(*[F.struct(order[k]["k"].alias("k"), inside[k].alias("x")) for k in range(size)]))

    order = F.array_sort(F.transform(x, lambda a, k: F.struct(a.alias("x"), k.alias("k"))))
    return F.transform(F.transform(F.array(order), placed)[0], lambda t: t["x"])


def grey_level(u: Column, gamma: float = 2.2) -> Column:
    """0 to 255 of a picture with this gamma."""
    return F.round(F.pow(F.greatest(u, F.lit(0.0)), F.lit(1 / gamma)) * 255)


def byte_level(u: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(255 * u)))
