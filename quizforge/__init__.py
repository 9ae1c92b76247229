"""Spark jobs that build, check, compose and score robustness variants of question sets."""
