"""Prompt construction as Column functions, with a registry of conditions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.text import S, strip
from tallyforge.shipping import ship

#: Fixed wording of the instructions.
COT_INSTRUCTION = "Think step by step, then give the final answer."
EXPLICIT_INSTRUCTION = (
    "The items above are examples of the task format.\n"
    "Solve the target question independently.\n"
    "Do not copy names, numbers, or answers from the examples.\n"
    "Return only the answer to the target question."
)
SYSTEM_PROMPT = "You are a helpful assistant."
PERMUTATION_SEED = 20260827
#: The line of a demonstration that holds its answer.
ANSWER_LINE = r"(?im)^(\s*)(Answer:|Sentiment:|Classify:|Subject:|Extract[^:\n]*:|Code:)([^\n]*)$"
_CUES = ("Answer:", "Code:")


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{S}+\z", "")


def direct_prompt(prompt: Column) -> Column:
    return prompt


def cot_prompt(prompt: Column) -> Column:
    """The prompt without a closing cue, then the step-by-step instruction on a line of its own."""
    body = F.regexp_replace(_rstrip(prompt), r"(?:Answer:|Code:)\z", "")
    return F.concat(_rstrip(body), F.lit("\n" + COT_INSTRUCTION))


def few_shot_prompt(prefix: Column, prompt: Column) -> Column:
    return F.concat(prefix, prompt)


def demonstration_blocks(prefix: Column) -> Column:
    return F.split(_rstrip(prefix), "\n\n")


def prefix_tail(prefix: Column) -> Column:
    """White space after the last demonstration, to be restored when the prefix is rebuilt."""
    return F.regexp_extract(prefix, rf"({S}*)\z", 1)


def _checked(block: Column) -> Column:
    return F.when(F.regexp_like(block, F.lit(ANSWER_LINE)), block).otherwise(F.raise_error(F.concat(F.lit("demonstration without an answer marker: "), block)))


def replace_answer(block: Column, value: Column) -> Column:
    """The block with ``value`` as its answer; lines after the answer's first line go, as answers may have several."""
    head = F.regexp_extract(_checked(block), r"(?s)\A(.*?)" + ANSWER_LINE.replace("(?im)^", r"(?im:^") + ")", 1)
    label = F.concat(F.regexp_extract(block, ANSWER_LINE, 1), F.regexp_extract(block, ANSWER_LINE, 2))
    return F.concat(head, label, F.lit(" "), value)


def block_answer(block: Column) -> Column:
    """The answer of a block with all its lines."""
    first = F.regexp_replace(F.regexp_extract(block, ANSWER_LINE, 3), rf"\A{S}+", "")
    rest = F.regexp_extract(block, r"(?s)\A.*?" + ANSWER_LINE.replace("(?im)^", r"(?im:^") + r")\n(.*)\z", 4)
    return F.concat_ws("\n", F.nullif(first, F.lit("")), F.nullif(rest, F.lit("")))


def few_shot_format_only(prefix: Column, prompt: Column) -> Column:
    """Demonstrations keep their form, and ``?`` stands for every answer."""
    blocks = F.transform(demonstration_blocks(prefix), lambda b: replace_answer(b, F.lit("?")))
    return F.concat(F.array_join(blocks, "\n\n"), prefix_tail(prefix), prompt)


def _shuffled(answers: list[str], task_id: int) -> list[str]:
    import random

    out = list(answers)
    random.Random(PERMUTATION_SEED + task_id).shuffle(out)
    return out


def _permute_udf():
    ship(SparkSession.active())
    return F.udf(_shuffled, T.ArrayType(T.StringType()))


def _with_answers(prefix: Column, prompt: Column, answers: Column) -> Column:
    blocks = F.zip_with(demonstration_blocks(prefix), answers, replace_answer)
    return F.concat(F.array_join(blocks, "\n\n"), prefix_tail(prefix), prompt)


def few_shot_random_label(task_id: Column, prefix: Column, prompt: Column) -> Column:
    """Demonstrations with their answers permuted by Python's seeded shuffle: bit-exact, hence a Python function over short arrays."""
    answers = F.transform(demonstration_blocks(prefix), block_answer)
    return _with_answers(prefix, prompt, _permute_udf()(answers, task_id.cast("int")))


def few_shot_hashed_label(task_id: Column, prefix: Column, prompt: Column) -> Column:
    """As ``few_shot_random_label``, with the order of a hash instead: native, and not the same permutation."""
    answers = F.transform(demonstration_blocks(prefix), block_answer)
    keyed = F.array_sort(F.transform(answers, lambda a, i: F.struct(F.xxhash64(F.lit(PERMUTATION_SEED), task_id, i).alias("k"), a.alias("a"))))
    return _with_answers(prefix, prompt, F.transform(keyed, lambda s: s["a"]))


def split_output_cue(target: Column) -> tuple[Column, Column]:
    """(body, cue) of a stripped target that may end with an output cue."""
    cue = F.regexp_extract(target, r"(Answer:|Code:)\z", 1)
    return F.when(cue != "", _rstrip(F.regexp_replace(target, r"(?:Answer:|Code:)\z", ""))).otherwise(target), cue


def delimited_prompt(examples: Column, target: Column, cue: Column, instruction: str | None = None) -> Column:
    parts = [F.lit("<EXAMPLES>"), examples, F.lit("</EXAMPLES>")]
    if instruction:
        parts += [F.lit(""), F.lit(instruction)]
    parts += [F.lit(""), F.lit("<TARGET>"), target, F.lit("</TARGET>")]
    return F.concat(F.concat_ws("\n", *parts), F.when(cue != "", F.concat(F.lit("\n\n"), cue)).otherwise(F.lit("")))


def ablation_prompts(prefix: Column, prompt: Column) -> Column:
    """Map of the four prompt formats of the ablation."""
    examples, target = _rstrip(prefix), strip(prompt)
    body, cue = split_output_cue(target)
    return F.create_map(
        F.lit("A_original"), F.concat(prefix, prompt),
        F.lit("B_delimiters"), delimited_prompt(examples, body, cue),
        F.lit("C_delimiters_and_instruction"), delimited_prompt(examples, body, cue, EXPLICIT_INSTRUCTION),
        F.lit("D_instruction_only"), F.concat_ws("\n\n", examples, F.lit(EXPLICIT_INSTRUCTION), target),
    )


def chat_messages(prompt: Column, mode: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    """Messages for chat models; null for raw ones, which take the prompt as it is."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.when(mode.isin("chat", "instruct"), F.array(message("system", F.lit(system_prompt)), message("user", prompt)))


def sample_seed(*parts: Column) -> Column:
    """Unsigned 32-bit seed of a cell: the first eight hex digits of the SHA-256 of its parts joined by ``|``."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long")


def ablation_seed(seed: Column, task_index: Column, condition_index: Column, sample_index: Column) -> Column:
    return seed + 10_000 * task_index + 1_000 * condition_index + sample_index


def preview(text: Column, n: int = 90) -> Column:
    """The last ``n`` characters on one line."""
    return F.replace(F.right(text, F.lit(n)), F.lit("\n"), F.lit(" / "))


#: Conditions by name: each builds the prompt of a table of tasks. Add entries to register more.
CONDITIONS: dict[str, Callable[[DataFrame], Column]] = {
    "direct": lambda t: direct_prompt(t["prompt"]),
    "cot": lambda t: cot_prompt(t["prompt"]),
    "few_shot": lambda t: few_shot_prompt(t["few_shot_prefix"], t["prompt"]),
    "few_shot_random_label": lambda t: few_shot_random_label(t["id"], t["few_shot_prefix"], t["prompt"]),
    "few_shot_format_only": lambda t: few_shot_format_only(t["few_shot_prefix"], t["prompt"]),
}
CONDITION_METADATA = {"few_shot_random_label": {"e1_label_permutation_seed": PERMUTATION_SEED}}


def build_prompts(tasks: DataFrame, condition: str) -> DataFrame:
    """The tasks with ``prompt_text`` of the condition."""
    return tasks.withColumn("prompt_text", CONDITIONS[condition](tasks))
