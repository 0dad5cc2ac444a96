"""The queries of the training-data operators and of the pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, html, interaction, language, mixing, nearjoin, packing, phrases, quality, secrets, urls, warc


def queries() -> dict:
    return {
        "op1_chat_hmm": chat.op1_chat_hmm,
        "op2_ngram_jaccard_join": nearjoin.op2_ngram_jaccard_join,
        "op3_warc_round_trip": warc.op3_warc_round_trip,
        "op4_entropy_mix": mixing.op4_entropy_mix,
        "op5_language_id": language.op5_language_id,
        "op6_secret_ledger": secrets.op6_secret_ledger,
        "op7_url_model_ratio": urls.op7_url_model_ratio,
        "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
        "op9_quality_divergence": quality.op9_quality_divergence,
        "op10_text_density": html.op10_text_density,
        "op11_filter_interaction": interaction.op11_filter_interaction,
        "op12_pattern_packing": packing.op12_pattern_packing,
        "op13_phrase_mining": phrases.op13_phrase_mining,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    found = {
        "op2_ngram_jaccard_join": nearjoin.OP2_SQL,
        "op3_warc_round_trip": warc.OP3_SQL,
        "op4_entropy_mix": mixing.OP4_SQL,
        "op6_secret_ledger": secrets.OP6_SQL,
        "op8_benchmark_decontamination": decontaminate.OP8_SQL,
        "op9_quality_divergence": quality.OP9_SQL,
        "op11_filter_interaction": interaction.OP11_SQL,
        "op13_phrase_mining": phrases.OP13_SQL,
    }
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
