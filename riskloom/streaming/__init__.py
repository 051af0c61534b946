"""Structured Streaming jobs (stateless scoring of request streams)."""
from .scoring import model_score, rule_score, score_directory_once, start_scoring_stream  # noqa: F401
