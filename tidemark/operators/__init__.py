"""Relational operators: statistics, detectors, review, apply, reports, evaluation."""
