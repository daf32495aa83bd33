"""Queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from mosaiq.llm import (
    bpe_stream, chat, decontaminate, ngram_quality, packing, phrases, sharding, simhash, spotsigs, substring, token_files, urls, weighted_lloyd,
)

QUERIES = {
    "op1_latent_decontamination": decontaminate.op1_latent_decontamination,
    "op2_spotsigs": spotsigs.op2_spotsigs,
    "op3_path_template_tree": urls.op3_path_template_tree,
    "op4_pack_configuration_lp": packing.op4_pack_configuration_lp,
    "op5_zstd_dictionary": token_files.op5_zstd_dictionary,
    "op6_token_assembly": chat.op6_token_assembly,
    "op7_label_propagation": sharding.op7_label_propagation,
    "op8_substring_seed_extend": substring.op8_substring_seed_extend,
    "op9_kneser_ney": ngram_quality.op9_kneser_ney,
    "op10_simhash_byte_index": simhash.op10_simhash_byte_index,
    "op11_weighted_lloyd": weighted_lloyd.op11_weighted_lloyd,
    "op12_apriori_phrases": phrases.op12_apriori_phrases,
    "op13_bounded_lookahead": bpe_stream.op13_bounded_lookahead,
}

ORACLE_SQL: dict[str, str] = {
    "op6_token_assembly": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
safe AS (SELECT *, regexp_replace(text, '(\\*)(### [\pL\pN_]+:|</turn>)', '\\\1\2', 'g') AS written FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(written) + 15) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id
""",
    "op11_weighted_lloyd": weighted_lloyd.ORACLE,
    "op12_apriori_phrases": phrases.ORACLE,
}
