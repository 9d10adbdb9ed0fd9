"""Settings of profiling and detection; every tunable has its default here."""

from __future__ import annotations

from dataclasses import dataclass

# The enumerations of issues, columns, suggestions and datasets.
ISSUE_TYPES = ("missing_value", "exact_duplicate", "fuzzy_duplicate", "inconsistent_format", "type_mismatch", "outlier", "suspicious_value")
SEVERITIES = ("high", "medium", "low")
DETECTED_BY = ("rule", "llm")
INFERRED_TYPES = ("string", "number", "date", "boolean", "email", "phone", "mixed")
ACTIONS = ("set_value", "normalize_value", "delete_row", "merge_rows", "no_action")
REVIEW_STATUSES = ("pending", "accepted", "rejected", "edited")
DATASET_STATUSES = ("uploaded", "profiling", "enriching", "ready")

# Thresholds and sizes of review.
#: Confidence from which a suggestion may be accepted in bulk.
BULK_CONFIDENCE = 0.7
#: Confidence of a card for a candidate that the reviewer left unanswered.
UNANSWERED_CONFIDENCE = 0.3
#: Candidates of one review request, and decisions of one apply request.
REVIEW_BATCH = 25
MAX_DECISIONS = 20_000


@dataclass(frozen=True)
class Config:
    #: Share of a column's values that the most common type needs, else "mixed".
    type_share: float = 0.6
    #: Share that the most common shape needs to count as the column's format.
    shape_share: float = 0.5
    sample_size: int = 10
    #: Outlier fences: multiples of the interquartile range, and values needed to set them.
    fence_k: float = 1.5
    fence_min_values: int = 8
    #: Rows that statistics read: all, or the first n (None: all).
    stats_rows: int | None = None
    #: Similarity of two rows from which they may be the same record.
    fuzzy_threshold: float = 0.85
    block_prefix: int = 3
    #: Rows of a block that meet in one place; larger blocks are cut into parts that meet pair by pair.
    max_block: int = 1000
    #: Bytes of drifting spellings up to which they go to every task; more of them meet cells by a shuffle.
    spelling_bytes: int = 32 << 20
    casing_types: tuple[str, ...] = ("string", "boolean")
    placeholder_names: tuple[str, ...] = ("test user", "test", "john doe", "jane doe", "foo bar", "asdf", "qwerty", "lorem ipsum", "sample user", "dummy")
    #: Digits a phone needs before identical ones count as filler.
    filler_digits: int = 7
    #: Confidences by kind of finding.
    confidence_missing: float = 0.9
    confidence_exact: float = 0.99
    confidence_phone: float = 0.96
    confidence_date: float = 0.9
    confidence_date_ambiguous: float = 0.6
    confidence_text: float = 0.94
    confidence_number: float = 0.92
    confidence_outlier: float = 0.91


DEFAULT = Config()
