"""Registered queries of the training-data operators and the SQL that some of them have."""

from __future__ import annotations

from assayer.llm import ann, bpe, chat, collocation, jaccard, license, mixing, neardup, quality, sharding, tokenfile, toxicity
from assayer.llm.common import table

QUERIES = {
    "op1_nearest": ann.nearest_report,
    "op2_jaccard": jaccard.jaccard_report,
    "op3_bpe": bpe.bpe_report,
    "op4_toxicity": toxicity.toxicity_report,
    "op5_near_duplicates": neardup.near_duplicate_report,
    "op6_licenses": license.license_report,
    "op7_sharding": sharding.shard_report,
    "op8_quality": quality.quality_report,
    "op9_token_files": tokenfile.token_file_report,
    "op10_mixing": lambda spark, sf_dir: mixing.mix_report(table(spark, sf_dir, "documents")),
    "op11_collocations": collocation.collocation_report,
    "op12_chat": chat.chat_report,
}
ORACLES = {
    "op1_nearest": ann.ORACLE,
    "op2_jaccard": jaccard.ORACLE,
    "op5_near_duplicates": neardup.ORACLE,
    "op6_licenses": license.oracle(),
    "op10_mixing": mixing.ORACLE,
    "op11_collocations": collocation.ORACLE,
    "op12_chat": chat.ORACLE,
}
