"""tabforge: Spark-native tabular profiling, feature, encoding, CV, stacking and
blending operators.

Every operator is a plain ``DataFrame -> DataFrame`` function, or a
``fit_*(train) -> small table`` / ``apply_*(df, fitted)`` pair so that leakage is
visible in the signature. Nothing row-level is collected on the driver; only
bounded summaries (per-column statistics, label tables, fold scores) are.
"""

from tabforge.session import build_session, cut_lineage, ensure_checkpoint_dir, fitted_table

__all__ = ["build_session", "cut_lineage", "ensure_checkpoint_dir", "fitted_table"]
