"""tally — Spark-native reconciliation of two tables.

``reconcile(source, target, ReconSpec(...))`` aligns the schemas, profiles the
column pairs (number / date / text), normalises keys and values, pairs rows on
a composite key (positions for duplicate keys) and returns lazy DataFrames for
cell discrepancies, rows missing on either side, side-by-side data, per-column
counts and a summary.
"""

from tally.plans.pipeline import ReconResult, prepare, reconcile
from tally.spec import ReconSpec, align, suggest_mapping

__all__ = ["ReconSpec", "ReconResult", "align", "prepare", "reconcile", "suggest_mapping"]
