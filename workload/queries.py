"""All registered queries."""

from workload import q_containment, q_files, q_merges, q_reports, q_rest, q_scan, q_targets  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
