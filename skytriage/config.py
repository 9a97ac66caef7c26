"""Frozen settings with their checks, and their YAML source."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, fields

#: The study's classes (kilonova, type Ia, superluminous I) and the class held out for novelty.
STUDY_CLASSES = {"kilonova": 64, "sn_ia": 90, "slsn_i": 95}
CLASS_IDS = (64, 90, 95)
HELD_OUT_CLASS = 15
TARGET_CLASS = 64
#: Days after the alert, passbands, adjacent pairs of them.
EPOCHS = (0.0, 2.0, 7.0)
PASSBANDS = (0, 1, 2, 3, 4, 5)
COLOR_PAIRS = ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5))
#: Columns that reveal what is known only after the event.
FORBIDDEN = ("peak_mjd", "peak_flux", "total_obs_count", "max_snr", "final_flux", "true_target", "target", "hostgal_specz", "true_z", "true_distmod")


# The settings' defaults below are fixed values of the study.


class ConfigError(ValueError):
    """A setting is out of its bounds."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class SelectionConfig:
    """Redshift-dependent chance of a spectrum, p_floor + (p_bright - p_floor) / (1 + exp((z - z_50) / w_z))."""

    seed: int = 42
    p_floor: float = 0.10
    p_bright: float = 0.80
    z_50: float = 0.5
    w_z: float = 0.15

    def __post_init__(self) -> None:
        _need(0 < self.p_floor < 1, "p_floor must lie in (0, 1)")
        _need(self.p_floor < self.p_bright <= 1, "p_bright must lie in (p_floor, 1]")
        _need(self.z_50 > 0 and self.w_z > 0, "z_50 and w_z must be positive")


@dataclass(frozen=True)
class FeatureConfig:
    snr_threshold: float = 5.0
    min_points_for_slope: int = 2
    min_points_for_snr_rate: int = 2
    max_color_dt_days: float = 0.5
    passbands: tuple[int, ...] = PASSBANDS

    def __post_init__(self) -> None:
        _need(self.snr_threshold > 0, "snr_threshold must be positive")
        _need(self.min_points_for_slope >= 2 and self.min_points_for_snr_rate >= 2, "a slope needs two points")
        _need(self.max_color_dt_days >= 0, "max_color_dt_days must not be negative")
        _need(len(set(self.passbands)) == len(self.passbands) and all(0 <= b <= 5 for b in self.passbands), "passbands are distinct numbers from 0 to 5")


@dataclass(frozen=True)
class DecisionConfig:
    """Gains of a true and a false trigger and of a missed and a rightly ignored object, capacity and novelty weight."""

    u_tp: float = 2.0
    u_fp: float = -1.0
    u_fn: float = 0.0
    u_tn: float = 0.0
    capacity: int = 5
    threshold: float = 0.001
    novelty_weight: float = 0.05
    deadline: float = 2.0

    def __post_init__(self) -> None:
        _need(self.u_tp > 0 >= self.u_fp, "a true trigger gains, a false one does not")
        _need(self.capacity >= 0, "capacity must not be negative")
        _need(self.novelty_weight >= 0, "novelty_weight must not be negative")
        _need(math.isfinite(self.threshold), "threshold must be finite")


@dataclass(frozen=True)
class PopulationConfig:
    kilonova: int = 64
    sn_ia: int = 90
    slsn_i: int = 95

    def __post_init__(self) -> None:
        _need({f.name: getattr(self, f.name) for f in fields(self)} == STUDY_CLASSES, "classes must be exactly the study's")


@dataclass(frozen=True)
class DatasetConfig:
    filename: str

    def __post_init__(self) -> None:
        _need(bool(self.filename) and os.path.basename(self.filename) == self.filename, "filename must be a bare name")


@dataclass(frozen=True)
class BaselineConfig:
    """Boosted trees per class."""

    rounds: int = 100
    depth: int = 5
    step: float = 0.05
    seed: int = 42

    def __post_init__(self) -> None:
        _need(self.rounds > 0 and 0 < self.depth <= 10 and 0 < self.step <= 1, "rounds, depth or step out of bounds")


@dataclass(frozen=True)
class BoostingConfig:
    """The reference's multi-class trees: rounds, depth, step, rows of a leaf at least, penalty of leaf values."""

    rounds: int = 100
    depth: int = 5
    step: float = 0.05
    leaf: int = 20
    l2: float = 1.0

    def __post_init__(self) -> None:
        _need(min(self.rounds, self.depth, self.leaf) > 0 and 0 < self.step <= 1 and self.l2 > 0, "boosting settings out of bounds")


def load_yaml(path: str, kind: type):
    """Settings of class `kind` from a YAML mapping, at a path or URI; unknown names are errors."""
    import yaml

    from .sources.shared import filesystem

    fs, place = filesystem(path)
    with fs.open_input_stream(place) as source:
        found = yaml.safe_load(source.read()) or {}
    unknown = set(found) - {f.name for f in fields(kind)}
    _need(not unknown, f"unknown settings: {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})
