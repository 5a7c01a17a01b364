"""DataFrame operators: grading, metrics, comparison, run logs, validation, reports."""
