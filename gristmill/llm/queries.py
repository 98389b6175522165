"""Queries of the corpus operators, and SQL for those that SQL can express."""

import corpus_pipeline
from gristmill.llm import chat, decontam, langid, mixing, quality, secrets, sharding, simhash, tokens, urls

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_mixing": mixing.op1_mixing,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_quality": quality.op5_quality,
    "op6_chat": chat.op6_chat,
    "op7_langid": langid.op7_langid,
    "op8_url_filters": urls.op8_url_filters,
    "op9_secrets": secrets.op9_secrets,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE = {
    "op1_mixing": mixing.ORACLE,
    "op8_url_filters": urls.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
