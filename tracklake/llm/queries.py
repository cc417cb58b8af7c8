"""The registered query of every operator, over its whole table with production parameters."""

from __future__ import annotations

from tracklake.llm import compression, conversations, decontamination, importance, licenses, packing, pii, quality, recompression, secret_scan, signature_tree, token_counts, toxicity
from tracklake.llm.registry import query, table


@query()
def op5_compression_bands(spark, folder):
    return compression.compression_rules(table(spark, folder, "documents"))


@query()
def op6_personal_data(spark, folder):
    return pii.personal_data(table(spark, folder, "documents")).drop("found")


@query()
def op9_secrets(spark, folder):
    return secret_scan.secrets(table(spark, folder, "documents")).drop("base", "tested")


@query(licenses.ORACLE_SQL)
def op3_license_rules(spark, folder):
    return licenses.license_scan(table(spark, folder, "documents"))


@query()
def op10_conflict_packing(spark, folder):
    return packing.pack(packing.measured(table(spark, folder, "documents")))


@query()
def op4_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op7_positive_unlabelled_quality(spark, folder):
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(decontamination.ORACLE_SQL)
def op1_template_decontamination(spark, folder):
    return decontamination.near_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(signature_tree.ORACLE_SQL)
def op8_signature_tree_join(spark, folder):
    return signature_tree.jaccard_components(table(spark, folder, "documents"))


@query(recompression.ORACLE_SQL)
def op2_recompression_dedup(spark, folder):
    return recompression.dedup_substrings(table(spark, folder, "documents"))


@query(importance.ORACLE_SQL)
def op13_importance_resampling(spark, folder):
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op12_token_transducer(spark, folder, vocabulary: str = "piece_bpe_32k.model"):
    """The path of the vocabulary is a parameter of the operator; the public package is asked for it here alone."""
    import public_tokenizers

    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(vocabulary))


@query(conversations.ORACLE_SQL)
def op11_conversation_repair(spark, folder):
    return conversations.repair(table(spark, folder, "conversations"))
