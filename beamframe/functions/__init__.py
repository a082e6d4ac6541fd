"""Scalar column functions. NaN means "no value" on entry: it becomes NULL inside and NaN only at the output edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: h*c/e in metre electronvolt.
HC_E = 6.62607015e-34 * 299792458.0 / 1.602176634e-19


def nan_to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def null_to_nan(v: Column) -> Column:
    return F.coalesce(v, F.lit(float("nan")))


def divide(a: Column, b: Column) -> Column:
    """a / b with NULL for a missing or zero denominator."""
    return F.when(b != 0, a / b)


def divide_ieee(a: Column, b: Column) -> Column:
    """a / b as floating-point hardware has it: inf or NaN for a zero denominator."""
    return F.when(b != 0, a / b).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))


def energy_to_wavelength(ev: Column) -> Column:
    """Photon energy (eV) to wavelength (m)."""
    return F.lit(HC_E) / ev


def momentum_transfer(dist: Column, x: Column, ev: Column) -> Column:
    """q (1/m) at distance x from the beam on a detector at dist; 0 at x = 0."""
    return F.when(x == 0, 0.0).otherwise(F.lit(4 * 3.141592653589793) / energy_to_wavelength(ev) / F.sqrt(4 * (dist / F.when(x != 0, x)) * (dist / F.when(x != 0, x)) + 1))


def absorption(a: Column, b: Column) -> Column:
    """-ln(a / b); NULL where it has no value."""
    r = divide(a, b)
    return F.when(r > 0, -F.log(r))


def log_scale(v: Column) -> Column:
    return F.log10(1 + v)


def calibrate_axis(i: Column, scale: float, offset: float) -> Column:
    return i * scale - offset


def rect_intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """(x, y, w, h) of two rectangles' intersection; w or h <= 0: none."""
    x, y = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    return x, y, F.least(a[0] + a[2], b[0] + b[2]) - x, F.least(a[1] + a[3], b[1] + b[3]) - y


def bin_edge(lo: Column, hi: Column, n: int, i: Column) -> Column:
    return F.when(i == n, hi).otherwise(lo + i * ((hi - lo) / n))


def edges_to_centers(lo: Column, hi: Column, n: int) -> Column:
    """Array of the centers of n equal bins."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (bin_edge(lo, hi, n, i) + bin_edge(lo, hi, n, i + 1)) / 2)


def bin_index(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bin of x, half-open but for the last, which is closed; NULL outside. The guess by division is set right against the edges."""
    guess = F.least(F.greatest(F.floor((x - lo) / (hi - lo) * n).cast("int"), F.lit(0)), F.lit(n - 1))
    fixed = F.when(x < bin_edge(lo, hi, n, guess), guess - 1).when((x >= bin_edge(lo, hi, n, guess + 1)) & (guess < n - 1), guess + 1).otherwise(guess)
    return F.when((x >= lo) & (x <= hi), F.when(x == hi, F.lit(n - 1)).otherwise(fixed))


def is_even(train_id: Column) -> Column:
    return F.pmod(train_id, F.lit(2)) == 0


def split_source(col: Column) -> Column:
    """struct(device, property, pipeline): "device property", and whether the device is an output channel."""
    device = F.substring_index(col, " ", 1)
    return F.struct(device.alias("device"), F.when(F.instr(col, " ") > 0, F.element_at(F.split(col, " ", 2), 2)).alias("property"), F.contains(device, F.lit(":output")).alias("pipeline"))


def drop_reason(missing: Column, total: Column, first: Column) -> Column:
    return F.format_string("Not found: %d out of %d: %s", missing, total, first)


def erf(x: Column) -> Column:
    """Error function by a rational approximation (error below 1.5e-7)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def curve(kind: str, x: Column, p: list) -> Column:
    """linear (a, b), cubic (a..d), gaussian, lorentzian (amplitude, centre, width, offset) and erf (the same)."""
    if kind == "linear":
        return p[0] * x + p[1]
    if kind == "cubic":
        return ((p[0] * x + p[1]) * x + p[2]) * x + p[3]
    u = (x - p[1]) / p[2]
    if kind == "gaussian":
        return p[0] * F.exp(-u * u / 2) + p[3]
    if kind == "lorentzian":
        return p[0] / (1 + u * u) + p[3]
    if kind == "erf":
        return p[0] * erf(u) + p[3]
    raise ValueError(f"unknown curve {kind!r}")
