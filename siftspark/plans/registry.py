"""All registered queries over the driver's tables, with their DuckDB forms.

Both forms round doubles to six places, for sums and logarithms differ in the
last bits from engine to engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.plans import audit_queries, feature_queries, finding_queries, flow_queries, job_queries, known_queries, verdict_queries

#: Columns of doubles, and of 32-bit integers that DuckDB would have as 64-bit ones.
_DOUBLES = {
    "report_verdicts": ["prob"], "path_stats": ["max_conf"], "report_paths": ["max_conf"], "file_risk": ["suspicious_ratio", "hostile_ratio", "suspicious_density", "hostile_density"], "top_risk": ["weighted_density"],
    **{f"features_{k}": ["value"] for k in ("paths", "aggregates", "attack", "token_pairs", "bigrams", "metrics", "formats", "structure", "external", "gaps", "text", "cooccurrence", "code_pairs", "symbol_pairs", "formula", "scores", "missing", "trigrams", "tokens", "tier_ngrams", "key_values", "symbols", "unsigned")}, "feature_catalog": ["total"], "top_offenders": ["prob"],
    "char_entropy": ["entropy"], "calibrated_scores": ["raw", "raw2", "p"], "invalid_breakpoints": ["x", "y"], "level_sweep": ["p", "threshold"], "decisions": ["prob"], "blend_fired": ["p", "threshold"],
    "worst_members": ["worst_prob"], "elevated_verdicts": ["prob"], "tree_scores": ["raw"], "tree_scores_sql": ["raw"], "explained": ["value"], "score_margins": ["margin", "shown"], "blended_grades": ["new_prob"],
    "job_score_reports": ["prob"], "job_route_scores": ["raw", "p"], "job_rollup": ["prob"], "decided_without_grid": ["prob", "threshold"], "general_sweep": ["p", "threshold"], "route_classes": ["p"], "routed_predictions": ["prob"], "policy_decisions": ["p", "threshold"],
    "divergent_thresholds": ["raw", "raw2"], "calibrated_grid": ["threshold"], "default_thresholds": ["hostile", "suspicious"], "dependency_grades": ["prob"],
    "job_throughput": ["wall_s", "per_s"], "best_runs": ["wall"], "run_goal": ["ratio"], "operating_points": ["precision", "recall"], "ensemble_scores": ["raw"], "score_bands": ["progress"], "ensemble_scores_by_paths": ["raw"], "flattened_metrics": ["v"], "job_member_verdicts": ["prob"], "trailing_rate": ["per_s"],
}
_INTS = {"top_findings": ["rank"], "member_top": ["rank"], "retained_files": ["rank"], "listing_appended": ["depth"], "content_groups": ["pids"], "grafted": ["depth"], "explained": ["rank"], "budgeted_refs": ["pos"], "mixed_batches": ["batch"], "closed_references": ["hop"], "reached_by_recursion": ["hop"], "grafted_subtrees": ["depth"], "job_backrefs": ["crit"]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rounded(query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[(F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

    return run


def _typed(name: str, sql: str) -> str:
    casts = [f'round(CAST("{c}" AS DOUBLE), 6) + 0.0::DOUBLE AS "{c}"' for c in _DOUBLES.get(name, [])] + [f'CAST("{c}" AS INTEGER) AS "{c}"' for c in _INTS.get(name, [])]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


for _m in (finding_queries, feature_queries, verdict_queries, known_queries, audit_queries, job_queries, flow_queries):
    QUERIES |= {k: _rounded(f) for k, f in _m.QUERIES.items()}
    ORACLES |= {k: _typed(k, s) for k, s in _m.ORACLES.items()}
