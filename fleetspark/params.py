"""Parameters of the operators: plain frozen dataclasses with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

PLANT = "PLANT"

# Rule kinds and the labels shown for them.
RULE_LABELS = {
    "zero": "Zero value / ゼロ値",
    "blank": "Blank / 空欄",
    "negative": "Negative / 負の値",
    "threshold": "Threshold / しきい値",
    "between": "Between / 範囲内",
    "color_scale": "Colour scale / カラースケール",
    "data_bar": "Data bar / データバー",
    "top_bottom": "Top / bottom N",
    "duplicate": "Duplicate / 重複",
    "text_contains": "Text contains / 文字列一致",
    "outlier_sigma": "Outlier (sigma) / 外れ値",
    "stuck": "Stuck value / 値が固着",
    "jump": "Sudden jump / 急変",
}
GRADIENT_KINDS = ("color_scale", "data_bar")
RULE_SCOPES = ("all", "numeric", "text", "selected", "pattern")

# Words that give away a channel's physical role, in resolving order.
ROLE_HINTS = {
    "ac_power": ("交流電力", "ac power", "ac_power", "有効電力"),
    "dc_power": ("直流電力", "dc power", "dc_power"),
    "irradiance_h": ("日射強度2", "水平", "horizontal"),
    "irradiance": ("日射", "irradian", "irradiance", "insolation"),
    "ac_energy": ("交流電力量", "ac energy", "電力量"),
    "temp": ("気温", "temperature", "外気温", "モジュール温度"),
}
ENERGY_WORD = "電力量"

# How far from the fleet a unit must be before it is called out.
VERDICT_DC_PCT = 2.0
VERDICT_EFFICIENCY_PT = 0.5
VERDICT_AC_PCT = 1.0
DAYLIGHT_MIN = 0.05
EFFICIENCY_MIN_DC = 5.0

# Verdict texts.
VERDICT_OK = "OK"
VERDICT_BOTH = "DC side + inverter / 直流側とインバータの両方"
VERDICT_DC = "DC side (array, strings, shading, soiling) / 直流側（アレイ・ストリング）"
VERDICT_INVERTER = "Inverter / インバータ"
VERDICT_UNEXPLAINED = (
    "Unexplained - check curtailment and downtime / 原因不明（出力制御・停止を確認）"
)

# Sentences of the findings, filled in by format_string.
FINDING_AC = "%s: AC energy %+.1f %% vs fleet"
FINDING_DC = ", DC side %+.1f %%"
FINDING_EFFICIENCY = ", efficiency %+.2f pt"
FINDING_VERDICT = " -> %s"
FINDING_MORE = "%d more unit(s) are below the fleet - see the table."
FINDING_NONE = "Every unit tracks the fleet median."
FINDING_LOST = "%s: %d minute(s) with no output under usable light, about %.0f kWh lost."

# Notes on how a file was read.
NOTE_UNIT_ROW = "unit row detected below the header"
NOTE_MULTI_ROW = "multi-row header combined"
NOTE_EMPTY = "dropped %d empty column(s)"
NOTE_POOR_TIME = "timestamp column '%s' parsed poorly (%d%%) - kept as text"
NOTE_CLOCK = "merged time-of-day column '%s' into the timestamp"
NOTE_RESAMPLED = "resampled to %s"

# Kinds whose readings are already amounts per interval.
DELTA_MARKERS = ("差分", "diff")


@dataclass(frozen=True)
class Rule:
    """One flagging rule; parameters a kind does not use are ignored."""

    kind: str = "zero"
    enabled: bool = True
    label: str = ""
    scope: str = "numeric"
    columns: tuple[str, ...] = ()
    pattern: str = ""
    operator: str = "<"
    value: float = 0.0
    value2: float = 0.0
    tolerance: float = 0.0
    percent: bool = False
    rank: int = 10
    bottom: bool = False
    text: str = ""
    scale_mode: str = "3color"
    scale_bounds: str = "auto"
    scale_values: tuple[float, ...] = ()

    def __post_init__(self):
        if self.kind not in RULE_LABELS:
            raise ValueError(f"unknown rule kind: {self.kind}")
        if self.scope not in RULE_SCOPES:
            raise ValueError(f"unknown rule scope: {self.scope}")

    @property
    def name(self) -> str:
        return self.label or RULE_LABELS[self.kind]


def default_rules() -> list[Rule]:
    return [
        Rule("zero"),
        Rule("blank", scope="all"),
        Rule("negative"),
        Rule("color_scale", enabled=False),
        Rule("stuck", value2=10, enabled=False),
        Rule("outlier_sigma", value2=4.0, enabled=False),
    ]


@dataclass(frozen=True)
class ReaderParams:
    # Candidate encodings, delimiters and no-value tokens.
    encodings: tuple[str, ...] = ("utf-8-sig", "cp932", "shift_jis", "utf-16", "euc_jp", "latin-1")
    delimiters: tuple[str, ...] = (",", "\t", ";")
    na_values: tuple[str, ...] = ("", "-", "--", "***", "N/A", "NA", "#N/A", "null", "NULL")
    thousands: str = ","
    header_row: int | None = None
    skip_rows: int = 0


@dataclass(frozen=True)
class IdentityParams:
    """How a file's timestamp, unit and day are found."""

    time_column: str | None = None
    # Words that hint at a time column.
    time_candidates: tuple[str, ...] = (
        "日時", "日付", "時刻", "計測日時", "収集日時", "年月日", "時間",
        "timestamp", "time", "datetime", "date",
    )
    entity_label: str = "PCS"
    entity_column: str | None = None
    entity_from_filename: str = r"^(\d+)"
    source_from_filename: str = ""
    entity_from_column: str = ""
    strip_entity_in_name: bool = True
    alarm_pattern: str = ""
    date_from_filename: str = r"(\d{4}[-_]\d{2}[-_]\d{2})"
    resample: str = ""


@dataclass(frozen=True)
class DictionaryParams:
    raw_col: str = "auto"
    name_col: str = "auto"
    unit_col: str = "auto"
    note_col: str = "auto"
    kind_col: str = "auto"
    multi_block: bool = True
    shared_markers: tuple[str, ...] = ("共通", "common")
    fuzzy_cutoff: float = 0.86


@dataclass(frozen=True)
class ColumnFilter:
    enabled: bool = False
    contains: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    keep_first_column: bool = True
    case_sensitive: bool = False
    use_raw_name: bool = True


@dataclass(frozen=True)
class AnalysisParams:
    deviation_mode: str = "mean"
    deviation_percent: bool = True
    deviation_floor_pct: float = 2.0
    deviation_floor_abs: float = 0.0
    round_to: int = 3
    flag_exclude: tuple[str, ...] = ("zero", "blank")
    stable_only: bool = True
    stable_min_irradiance: float = 0.4
    stable_tolerance_pct: float = 5.0
    stable_window: int = 5
    capacity_kw: float = 0.0
    capacity_by_unit: dict[str, float] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    time_from: str = ""
    time_to: str = ""


@dataclass(frozen=True)
class ChartSpec:
    """X, Y and grouping of one chart; an empty x_column means time."""

    title: str = ""
    x_column: str = ""
    y_columns: tuple[str, ...] = ()
    group_mode: str = "single"
    patterns: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    normalize: bool = False
    max_points: int = 4000
