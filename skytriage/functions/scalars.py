"""Column expressions; all of them stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DecisionConfig, FeatureConfig, SelectionConfig

#: Feature statuses as integers; anything else is -1.
WELL, FEW_POINTS, NO_BASELINE, NON_POSITIVE, NO_PAIR, NO_DETECTION = range(6)
STATUS_NAMES = ("well_constrained", "unconstrained_insufficient_observations", "unconstrained_zero_baseline", "unconstrained_non_positive_flux", "unconstrained_no_passband_pair", "unconstrained_no_detection")


def status_code(name: Column) -> Column:
    out = F.when(F.lit(False), -1)
    for code, text in enumerate(STATUS_NAMES):
        out = out.when(name == text, code)
    return out.otherwise(-1)


def snr(flux: Column, flux_err: Column) -> Column:
    return F.when(flux_err > 0, flux / flux_err).otherwise(F.lit(0.0))


def is_detected(flux: Column, flux_err: Column, flag: Column, config: FeatureConfig = FeatureConfig()) -> Column:  # noqa: B008
    return F.coalesce(snr(flux, flux_err) >= config.snr_threshold, F.lit(False)) | F.coalesce(flag == 1, F.lit(False))


def logistic(z: Column, floor: float, bright: float, middle: float, width: float) -> Column:
    """Falls from bright to floor around middle; a large exponent overflows to infinity and so to the floor."""
    return floor + (bright - floor) / (1.0 + F.exp((z - middle) / width))


def selection_probability(z: Column, c: SelectionConfig = SelectionConfig()) -> Column:  # noqa: B008
    return logistic(z, c.p_floor, c.p_bright, c.z_50, c.w_z)


def inverse_weight(p: Column) -> Column:
    """The weight 1 / p of a selected object; null where nothing is selected."""
    return F.try_divide(F.lit(1.0), p)


def hash_uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform on [0, 1) from the first 32 bits of md5('seed:key:...'): the same at any partitioning, in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


#: Fixed values of the 32-bit mixing of draws: two multipliers, the step from one replicate to the next, all bits.
MIX_ONE, MIX_TWO, MIX_STEP, MIX_ALL = 0x21F0AAAD, 0x735A2D97, 0x9E3779B1, 0xFFFFFFFF


def mix32(x: int) -> int:
    """One number of 32 bits, mixed; the same as mixed()."""
    x = (x ^ x >> 16) * MIX_ONE & MIX_ALL
    x = (x ^ x >> 15) * MIX_TWO & MIX_ALL
    return x ^ x >> 15


def draw_keys(seed: int) -> tuple[int, int]:
    """Two numbers that carry a seed into both halves of a draw's state."""
    first = mix32(seed & MIX_ALL ^ 0x5BD1E995)
    return first, mix32(first ^ seed >> 32 & MIX_ALL ^ 0x1B873593)


def mixed(df: DataFrame, name: str) -> DataFrame:
    """df with 32 bits of a long column mixed in place; a column for each step, so that none is computed twice."""
    h = F.col(name)
    df = df.withColumn(name, (h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(MIX_ONE)).bitwiseAND(F.lit(MIX_ALL)))
    df = df.withColumn(name, (h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(MIX_TWO)).bitwiseAND(F.lit(MIX_ALL)))
    return df.withColumn(name, h.bitwiseXOR(F.shiftright(h, 15)))


def poisson_steps(rate: float = 1.0, most: int = 12) -> list[float]:
    """Distribution function of Poisson(rate) at 0, 1, ..., most - 1; the tail beyond is below 1e-9 for rates up to 1."""
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(most):
        total += term
        out.append(total)
        term *= rate / (k + 1)
    return out


def poisson(u: Column, rate: float = 1.0) -> Column:
    """Poisson(rate) by its inverse distribution."""
    steps = poisson_steps(rate)
    out = F.when(u < steps[0], 0)
    for k, c in enumerate(steps[1:], 1):
        out = out.when(u < c, k)
    return out.otherwise(len(steps))


def color(f1: Column, f2: Column) -> Column:
    return F.when((f1 > 0) & (f2 > 0), -2.5 * F.log10(f1 / f2))


def color_error(f1: Column, e1: Column, f2: Column, e2: Column) -> Column:
    return F.when((f1 > 0) & (f2 > 0), F.lit(2.5 / math.log(10)) * F.sqrt((e1 / f1) * (e1 / f1) + (e2 / f2) * (e2 / f2)))


def clipped_log(p: Column, eps: float = 1e-7) -> Column:
    return F.log(F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps)))


def normalized(*p: Column) -> list[Column]:
    """Shares of the sum; 0 each where the sum is 0."""
    total = sum(p[1:], p[0])
    return [F.when(total > 0, x / total).otherwise(F.lit(0.0)) for x in p]


def fused_score(p: Column, novelty: Column, scale: Column | float, weight: float) -> Column:
    if weight < 0:
        raise ValueError("novelty weight must not be negative")
    scale = F.lit(scale) if not isinstance(scale, Column) else scale
    return p + weight * novelty / F.when(scale > 0, scale).otherwise(F.lit(1.0))


def object_utility(triggered: Column, is_target: Column, c: DecisionConfig = DecisionConfig()) -> Column:  # noqa: B008
    return F.when(triggered & is_target, F.lit(c.u_tp)).when(triggered, F.lit(c.u_fp)).when(is_target, F.lit(c.u_fn)).otherwise(F.lit(c.u_tn))


def absolute_magnitude_r(distmod: Column, mwebv: Column) -> Column:
    return F.lit(-19.3) + distmod + 3.1 * mwebv


#: Typical absolute magnitudes by class.
MAGNITUDES = {64: -15.5, 90: -19.3, 95: -21.5}


def expected_snr(cls: Column, distmod: Column, mwebv: Column) -> Column:
    m = F.when(F.lit(False), 0.0)
    for k, v in MAGNITUDES.items():
        m = m.when(cls == k, F.lit(v))
    return F.pow(F.lit(10.0), -0.4 * (m + distmod + 3.1 * mwebv - 27.5)) / 5.0


def tenth_bin(p: Column) -> Column:
    """Ten equal bins of [0, 1], the last one closed, by comparison with k * 0.1; values outside are in no bin."""
    out = F.when((p < 0) | (p > 1), F.lit(None))
    for k in range(9, 0, -1):
        out = out.when(p >= k * 0.1, k)
    return out.when(p >= 0, 0).cast("int")
