from .casting import cast_loss
from .explore import Answer, answer, explore, relation
from .history import metric_history, table_metric_history
from .keys import (
    domain_violations,
    duplicates,
    join_cardinality,
    orphan_keys,
    orphans,
    reconcile_measure,
    retention,
)
from .lineage import (
    FEED_EDGES,
    KEYED_EDGES,
    MODEL_EDGES,
    Edge,
    lineage_upstream,
    neighbours,
    reconcile_lineage,
    upstream,
)
from .profile import (
    SKETCH_ERROR,
    catalog_inventory,
    column_profile,
    day_sketches,
    merged_profile,
    schema_changes,
    schema_diff,
    table_inventory,
)
from .report import KeyCheck, Keyed, key_outcomes, outcome, quality_report, row_outcomes
from .trends import calendar_gaps, kpi_change, kpi_change_sets, null_drift, volume_anomalies

__all__ = [
    "FEED_EDGES",
    "KEYED_EDGES",
    "MODEL_EDGES",
    "SKETCH_ERROR",
    "Answer",
    "Edge",
    "KeyCheck",
    "Keyed",
    "answer",
    "calendar_gaps",
    "cast_loss",
    "catalog_inventory",
    "column_profile",
    "day_sketches",
    "domain_violations",
    "duplicates",
    "explore",
    "join_cardinality",
    "key_outcomes",
    "kpi_change",
    "kpi_change_sets",
    "lineage_upstream",
    "merged_profile",
    "metric_history",
    "neighbours",
    "null_drift",
    "orphan_keys",
    "orphans",
    "outcome",
    "quality_report",
    "reconcile_lineage",
    "reconcile_measure",
    "relation",
    "retention",
    "row_outcomes",
    "schema_changes",
    "schema_diff",
    "table_inventory",
    "table_metric_history",
    "upstream",
    "volume_anomalies",
]
