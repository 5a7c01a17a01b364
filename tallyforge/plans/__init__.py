"""Query plans of the evaluation engine."""
