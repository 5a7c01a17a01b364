"""Explicit schemas of the tables that files are read into."""

from __future__ import annotations

from collections.abc import Iterable


def unused_name(name: str, *columns: Iterable[str]) -> str:
    """The name, with underscores before it until none of the columns is called so."""
    taken = {c.lower() for some in columns for c in some}
    while name.lower() in taken:
        name = f"_{name}"
    return name


TASK = "id long, category string, difficulty string, answer_type string, unit string, labels array<string>, code_tests string, prompt string, few_shot_prefix string, gold_answer string"
TASK_FILE = f"version string, created string, note string, prompts array<struct<{TASK.replace(' ', ':').replace(',:', ',')}>>"
OUTPUTS_WIDE = "task_id long, category string, difficulty string, gold_answer string, base_zero_shot string, base_few_shot string, instruct_zero_shot string, instruct_few_shot string"
GENERATION = (
    "benchmark_version string, problem_id long, model_id string, model_mode string, condition string, sample_index long, seed long, do_sample boolean, temperature double, "
    "max_new_tokens long, prompt_text string, completion_text string, n_input_tokens long, n_output_tokens long, elapsed_seconds double, error string"
)
RUN_CONFIG = (
    "run_id string, created_utc string, benchmark string, benchmark_version string, models array<struct<model_id:string,mode:string>>, condition string, problem_ids string, n_samples long, "
    "do_sample boolean, temperature double, max_new_tokens long, base_seed long, seed_policy string, system_prompt string, quantize boolean, condition_metadata map<string,string>"
)
PREDICTION = (
    "problem_id long, model_id string, condition string, sample_index long, seed long, gold_answer string, answer_type string, extraction_version string, n_output_tokens long, status string, "
    "prediction string, strategy string, candidates array<string>, unit string, flags array<string>, correct boolean, category string"
)
PREDICTION_FILE = f"graded_utc string, extraction_version string, n long, predictions array<struct<{PREDICTION.replace(', ', ',').replace(' ', ':')}>>"
CELL = ("benchmark_version", "model_id", "condition", "problem_id", "sample_index")
ABLATION_TASK = "task_id long, category string, difficulty string, gold_answer string, conditions map<string,struct<user_prompt:string,samples:array<struct<seed:long,output:string>>>>"
OVERRIDES = "task_id long, condition string, correct boolean, reason string"
