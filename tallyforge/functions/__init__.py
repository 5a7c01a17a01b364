"""Column functions: text, answer extraction, legacy rule sets, statistics, prompts."""
