"""DataFrame -> DataFrame operators."""

from ratelake.operators.anomalies import flag_anomalies
from ratelake.operators.changes import delete_gate, detect_changes, has_deletes
from ratelake.operators.clean import clean_rates, drop_report, in_range, valid_days
from ratelake.operators.coverage import coverage_gaps, coverage_report, coverage_summary
from ratelake.operators.day_bitmaps import (
    bitmap_days,
    coverage_from_bitmaps,
    day_bitmaps,
    days_covered,
    merge_bitmaps,
)
from ratelake.operators.digests import (
    detect_changes_by_digest,
    differing_cells,
    month_digests,
    stored_digests,
)
from ratelake.operators.events import to_events
from ratelake.operators.merge import live_rows, merge_changes
from ratelake.operators.metrics import rolling_metrics
from ratelake.operators.moments import (
    merge_moments,
    monthly_moments,
    summary_of,
    updated_moments,
)
from ratelake.operators.monthly import monthly_summary
from ratelake.operators.star import (
    convert_transactions,
    currency_dimension,
    dimension,
    fact_rates,
    fact_transactions,
)

__all__ = [
    "bitmap_days",
    "clean_rates",
    "convert_transactions",
    "coverage_from_bitmaps",
    "coverage_gaps",
    "coverage_report",
    "coverage_summary",
    "currency_dimension",
    "day_bitmaps",
    "days_covered",
    "delete_gate",
    "detect_changes",
    "detect_changes_by_digest",
    "differing_cells",
    "dimension",
    "drop_report",
    "fact_rates",
    "fact_transactions",
    "flag_anomalies",
    "has_deletes",
    "in_range",
    "live_rows",
    "merge_bitmaps",
    "merge_changes",
    "merge_moments",
    "month_digests",
    "monthly_moments",
    "monthly_summary",
    "rolling_metrics",
    "stored_digests",
    "summary_of",
    "to_events",
    "updated_moments",
    "valid_days",
]
