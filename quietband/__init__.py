"""Spectral anomaly analytics over wide numeric DataFrames."""

from quietband.plans.analysis import AnalysisConfig, AnalysisResult, run_analysis

__all__ = ["AnalysisConfig", "AnalysisResult", "run_analysis"]
