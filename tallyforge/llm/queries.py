"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import chat, decontaminate, htmltext, interaction, jaccard, mixing, negatives, packing, pii, quality, sharding, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_sharding": sharding.op2_shards,
    "op3_chat": chat.op3_chat,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_html": htmltext.op5_html,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_warc": warc.op9_warc,
    "op10_pii": pii.op10_pii,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_mix": mixing.op12_mix,
    "op13_filter_audit": interaction.op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op3_chat": chat.OP3_SQL,
    "op4_url_filter": urlfilter.OP4_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_mix": mixing.op12_mix,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op13_filter_audit": interaction.OP13_SQL,
}
