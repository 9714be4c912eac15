"""Fleet telemetry analytics as DataFrame-to-DataFrame operators on Spark."""

from fleetspark.params import (
    AnalysisParams,
    ChartSpec,
    ColumnFilter,
    DictionaryParams,
    IdentityParams,
    ReaderParams,
    Rule,
    default_rules,
)

__all__ = [
    "AnalysisParams",
    "ChartSpec",
    "ColumnFilter",
    "DictionaryParams",
    "IdentityParams",
    "ReaderParams",
    "Rule",
    "default_rules",
]
