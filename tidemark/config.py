"""The study's configuration: a YAML file over defaults, checked when it is made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

#: Minutes of each timeframe's label.
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1D": 1440}
#: Closed bars that each mode of indicators stands behind the latest one.
SHIFTS = {"latest_closed": 0, "previous_closed": 1}
CROSS_MODES = ("same_period", "selected_pairs", "all_pairs")


class ConfigError(ValueError):
    """A configuration that can't be run; the message names the setting."""


def _require(test: bool, message: str) -> None:
    if not test:
        raise ConfigError(message)


@dataclass(frozen=True)
class Source:
    path: str
    timeframe: str
    role: str = "base"
    format: str = "mt5_tsv"


@dataclass(frozen=True)
class EventConfig:
    directions: tuple[str, ...] = ("up", "down")
    thresholds_pips: tuple[float, ...] = (20, 30, 50)
    horizons_minutes: tuple[int, ...] = (60, 120, 240)
    canonical_rule: str = "earliest_qualifying"
    suppression_rule: str = "horizon"
    extra_separation_minutes: int = 0
    require_source_quality: bool = True
    require_complete_horizon: bool = True
    require_observed_bars: bool = True
    exclude_ambiguous_first_touch: bool = False
    compression_primary_column: str | None = None
    compression_compressed_max_percentile: float = 0.25
    compression_expanding_min_percentile: float = 0.75
    consolidation_episode_separation_minutes: int = 240
    controls_per_event: int = 3
    random_controls_per_event: int = 3
    control_purge_minutes: int = 240
    match_on_session: bool = True
    match_on_hour_bucket: bool = True
    match_on_day_of_week: bool = False
    volatility_column: str | None = None
    volatility_bins: int = 4
    hour_bucket_hours: int = 4
    random_seed: int = 1

    def __post_init__(self) -> None:
        _require(bool(self.directions) and set(self.directions) <= {"up", "down"}, "step2.directions: up, down or both")
        _require(bool(self.thresholds_pips) and min(self.thresholds_pips) > 0, "step2.thresholds_pips: positive numbers")
        _require(bool(self.horizons_minutes) and min(self.horizons_minutes) > 0, "step2.horizons_minutes: positive numbers")
        _require(self.canonical_rule == "earliest_qualifying", "step2.canonical_rule: earliest_qualifying")
        _require(self.suppression_rule in ("horizon", "to_threshold"), "step2.suppression_rule: horizon or to_threshold")
        counts = (self.controls_per_event, self.random_controls_per_event, self.control_purge_minutes, self.extra_separation_minutes, self.consolidation_episode_separation_minutes)
        _require(min(counts) >= 0, "step2: counts and minutes are not negative")
        _require(self.volatility_bins >= 2 and 24 % self.hour_bucket_hours == 0, "step2: at least 2 volatility_bins, and hour_bucket_hours divides 24")
        _require(0 < self.compression_compressed_max_percentile < self.compression_expanding_min_percentile < 1, "step2: compressed below expanding, both in (0, 1)")

    @property
    def strata(self) -> list[tuple[str, float, int]]:
        return [(d, x, h) for d in self.directions for x in self.thresholds_pips for h in self.horizons_minutes]

    @property
    def match_keys(self) -> list[str]:
        keys = {"session": self.match_on_session, "hour_bucket": self.match_on_hour_bucket, "weekday": self.match_on_day_of_week}
        return [*(k for k, on in keys.items() if on), "volatility"]


@dataclass(frozen=True)
class ReportConfig:
    report_horizons_minutes: tuple[int, ...] = ()
    report_thresholds_pips: tuple[float, ...] = ()
    distribution_quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)

    def __post_init__(self) -> None:
        _require(all(0 <= q <= 1 for q in self.distribution_quantiles), "step3a.distribution_quantiles: in [0, 1]")


@dataclass(frozen=True)
class CheckpointConfig:
    primary_threshold_pips: float | None = None
    primary_horizon_minutes: int | None = None
    secondary_endpoints: tuple = ()
    state_timeframe: str | None = None
    compression_column: str | None = None
    crossover_direction_column: str | None = None
    htf_alignment_timeframe: str | None = None
    htf_alignment_column: str | None = None
    htf_alignment_min_abs_ordering: float = 0.5
    crossover_timeframes: tuple[str, ...] = ()
    crossover_indicator_families: tuple[str, ...] = ("ema", "sma", "ema_vs_sma")
    crossover_episode_gap_bars: int = 12
    risk_set_controls_per_event: int = 3
    random_context_controls: int = 20_000
    volatility_bins: int = 4
    hour_bucket_hours: int = 4
    random_seed: int = 1

    def __post_init__(self) -> None:
        _require(set(self.crossover_indicator_families) <= {"ema", "sma", "ema_vs_sma"}, "day2_checkpoint.crossover_indicator_families: ema, sma, ema_vs_sma")
        _require(min(self.crossover_episode_gap_bars, self.risk_set_controls_per_event, self.random_context_controls) >= 0, "day2_checkpoint: counts are not negative")


#: Settings of a file that say nothing about results: folders, sizes of chunks and samples, notes and logs.
LEFT_ASIDE = {"output_dir", "write_full_datasets", "chunk_rows", "sample_rows", "random_seed", "log_level", "source_timezone_mode", "source_timezone_note", "compression_min_consecutive_bars", "outcome_filter_general_controls", "exploratory_feature_families"}
WIDE = ("dist_pips", "dist_atr", "slope_atr", "slope_pips", "slope_raw", "slope_sign")
BETWEEN = ("value_dist_pips", "value_dist_atr", "slope_diff_atr", "slope_sign_agree", "slope_ratio")


@dataclass(frozen=True)
class StudyConfig:
    sources: tuple[Source, ...]
    symbol: str = "EURUSD"
    pip_size: float = 0.0001
    point_size: float = 0.00001
    timestamp_semantics: str = "bar_open"
    base_timeframe: str = "5m"
    timeframes: tuple[str, ...] = ("5m", "15m", "1h", "4h", "1D")
    include_daily: bool = False
    ema_periods: tuple[int, ...] = ()
    sma_periods: tuple[int, ...] = ()
    price_basis: str = "heikin_ashi"
    atr_price_basis: str = "standard"
    outcome_price_basis: str = "standard"
    outcome_entry_reference: str = "decision_bar_close"
    indicator_source_mode: str = "latest_closed"
    indicator_source_shift_bars: int | None = None
    atr_period: int = 14
    slope_lookbacks: tuple[int, ...] = (1, 3, 5)
    primary_slope_lookback: int = 3
    consolidation_windows: tuple[int, ...] = (6, 12, 24)
    crossover_windows: tuple[int, ...] = (6, 24)
    dispersion_change_lookback: int = 6
    entanglement_atr_fraction: float = 0.1
    compression_percentile_lookback: int = 1000
    compression_percentile_threshold: float = 0.25
    trend_ordering_threshold: float = 0.5
    cross_tf_mode: str = "same_period"
    cross_tf_selected_pairs: tuple[tuple[str, str], ...] = ()
    wide_per_indicator_features: tuple[str, ...] = ("dist_pips", "dist_atr", "slope_atr")
    cross_tf_per_indicator_features: tuple[str, ...] = ("value_dist_pips", "value_dist_atr", "slope_diff_atr")
    forward_horizons_minutes: tuple[int, ...] = (15, 30, 60, 120, 240)
    expansion_thresholds_pips: tuple[float, ...] = (20, 30, 50)
    research_mode: str = "production"
    step2: EventConfig = field(default_factory=EventConfig)
    step3a: ReportConfig = field(default_factory=ReportConfig)
    day2_checkpoint: CheckpointConfig = field(default_factory=CheckpointConfig)

    def __post_init__(self) -> None:
        minutes, base = MINUTES, self.base_timeframe
        _require(self.pip_size > 0 and self.point_size > 0, "pip_size and point_size: positive")
        _require(self.timestamp_semantics in ("bar_open", "bar_close"), "timestamp_semantics: bar_open or bar_close")
        _require(all(tf in minutes for tf in self.timeframes), f"timeframes: known ones are {', '.join(minutes)}")
        _require(base in self.timeframes, "base_timeframe: one of timeframes")
        _require(all(minutes[tf] % minutes[base] == 0 for tf in self.timeframes), "timeframes: multiples of the base")
        _require(self.research_mode in ("production", "smoke"), "research_mode: production or smoke")
        _require(self.research_mode != "production" or bool(self.ema_periods or self.sma_periods), "production mode names ema_periods or sma_periods")
        _require(bool(self.ema_periods or self.sma_periods), "ema_periods or sma_periods: at least one period")
        for name in ("ema_periods", "sma_periods"):
            periods = getattr(self, name)
            _require(all(p >= 1 for p in periods) and list(periods) == sorted(set(periods)), f"{name}: at least 1, ascending, each once")
        for name in ("price_basis", "atr_price_basis"):
            _require(getattr(self, name) in ("standard", "heikin_ashi"), f"{name}: standard or heikin_ashi")
        _require(self.outcome_price_basis == "standard" and self.outcome_entry_reference == "decision_bar_close", "outcomes: of standard prices, from the decision bar's close")
        _require(self.indicator_source_mode in SHIFTS, f"indicator_source_mode: {' or '.join(SHIFTS)}")
        _require(self.indicator_source_shift_bars in (None, SHIFTS[self.indicator_source_mode]), "indicator_source_shift_bars contradicts indicator_source_mode")
        _require(self.atr_period >= 1 and self.dispersion_change_lookback >= 1 and self.compression_percentile_lookback >= 1, "atr_period and lookbacks: at least 1")
        _require(bool(self.slope_lookbacks and self.consolidation_windows and self.crossover_windows), "windows and lookbacks: at least one each")
        _require(min(*self.slope_lookbacks, *self.consolidation_windows, *self.crossover_windows, 1) >= 1, "windows and lookbacks: at least 1")
        _require(self.primary_slope_lookback in self.slope_lookbacks, "primary_slope_lookback: one of slope_lookbacks")
        _require(0 < self.compression_percentile_threshold < 1 and 0 <= self.trend_ordering_threshold <= 1 and self.entanglement_atr_fraction > 0, "thresholds: compression in (0, 1), trend in [0, 1], entanglement above 0")
        _require(self.cross_tf_mode in CROSS_MODES, f"cross_tf_mode: {', '.join(CROSS_MODES)}")
        _require(self.cross_tf_mode != "selected_pairs" or bool(self.cross_tf_selected_pairs), "selected_pairs: cross_tf_selected_pairs is empty")
        _require(all(len(p) == 2 and set(p) <= set(self.active_timeframes) for p in self.cross_tf_selected_pairs), "cross_tf_selected_pairs: pairs of active timeframes")
        _require(set(self.wide_per_indicator_features) <= set(WIDE), f"wide_per_indicator_features: {', '.join(WIDE)}")
        _require(set(self.cross_tf_per_indicator_features) <= set(BETWEEN), f"cross_tf_per_indicator_features: {', '.join(BETWEEN)}")
        _require(all(h > 0 and h % minutes[base] == 0 for h in self.forward_horizons_minutes), "forward_horizons_minutes: multiples of the base")
        _require(all(x > 0 for x in self.expansion_thresholds_pips), "expansion_thresholds_pips: positive")
        _require(set(self.step2.horizons_minutes) <= set(self.forward_horizons_minutes) and set(self.step2.thresholds_pips) <= set(self.expansion_thresholds_pips), "step2: horizons and thresholds are among the outcomes'")
        bases = [s for s in self.sources if s.role == "base"]
        _require(len(bases) == 1 and bases[0].timeframe == base, "sources: exactly one base, of base_timeframe")

    @property
    def shift(self) -> int:
        return SHIFTS[self.indicator_source_mode]

    @property
    def active_timeframes(self) -> list[str]:
        return sorted((tf for tf in self.timeframes if tf != "1D" or self.include_daily), key=MINUTES.get)

    @property
    def higher_timeframes(self) -> list[str]:
        return [tf for tf in self.active_timeframes if tf != self.base_timeframe]

    @property
    def timeframe_pairs(self) -> list[tuple[str, str]]:
        """Every lower timeframe with every higher one, or the selected pairs."""
        if self.cross_tf_mode == "selected_pairs":
            return [(a, b) for a, b in self.cross_tf_selected_pairs]
        return [(a, b) for i, a in enumerate(self.active_timeframes) for b in self.active_timeframes[i + 1 :]]

    def combinations(self, averages: list[str]) -> list[tuple[int, int]]:
        """Places of the averages that are compared between two timeframes."""
        places = range(len(averages))
        return [(i, j) for i in places for j in places] if self.cross_tf_mode == "all_pairs" else [(i, i) for i in places]

    @property
    def compression_column(self) -> str:
        """The percentile that says whether a bar is compressed: the one named, or that of the middle window of the base timeframe."""
        windows = self.consolidation_windows
        return self.step2.compression_primary_column or f"{self.base_timeframe}__compression_percentile_{windows[len(windows) // 2]}"

    @property
    def volatility_column(self) -> str:
        return self.step2.volatility_column or f"{self.base_timeframe}__atr_pips"

    @property
    def warmup_bars(self) -> int:
        longest = max(*self.consolidation_windows, *self.crossover_windows, self.dispersion_change_lookback, self.atr_period)
        return max((*self.ema_periods, *self.sma_periods, 0)) + self.shift + max(self.slope_lookbacks) + longest

    @property
    def base_source(self) -> Source:
        return next(s for s in self.sources if s.role == "base")

    @property
    def points_per_pip(self) -> int:
        return round(self.pip_size / self.point_size)

    def to_dict(self) -> dict:
        return asdict(self)


def _made(kind: type, given: Mapping, where: str) -> dict:
    """Settings of `kind`, lists as tuples. A setting that is not known is refused, for it would have no effect."""
    names = {f.name for f in fields(kind)}
    tupled = lambda x: tuple(map(tupled, x)) if isinstance(x, list) else x
    _require(isinstance(given, Mapping) and all(isinstance(k, str) for k in given), f"{where}: settings have names")
    unknown = sorted(set(given) - names - LEFT_ASIDE)
    _require(not unknown, f"{where}: unknown settings {', '.join(unknown)}")
    return {k: tupled(v) for k, v in given.items() if k in names}


def from_dict(given: Mapping, folder: str = ".", **overrides) -> StudyConfig:
    """Relative paths of sources are relative to `folder`; overrides that are not None win over the file."""
    _require(isinstance(given, Mapping) and bool(given.get("sources")), "sources: at least one")
    given = {**given, **{k: v for k, v in overrides.items() if v is not None}}
    made = _made(StudyConfig, given, "study")
    place = lambda p: p if "://" in p or Path(p).is_absolute() else str((Path(folder) / p).resolve())
    made["sources"] = tuple(Source(**{**_made(Source, s, "sources"), "path": place(s["path"])}) for s in given["sources"])
    for name, kind in (("step2", EventConfig), ("step3a", ReportConfig), ("day2_checkpoint", CheckpointConfig)):
        made[name] = kind(**_made(kind, given.get(name) or {}, name))
    return StudyConfig(**made)


def load(path: str, **overrides) -> StudyConfig:
    import yaml

    text = Path(path).read_text(encoding="utf-8-sig")
    return from_dict(yaml.safe_load(text) or {}, str(Path(path).parent), **overrides)
