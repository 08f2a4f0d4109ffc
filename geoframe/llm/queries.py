"""The queries of the training-data operators, and their SQL where SQL can express them."""

from geoframe.llm import embedding_dedup, language_id, ngram_join, order_minhash, packing, pii, sentencepiece, substring_dedup, toxicity, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_embedding_near_dedup": embedding_dedup.op3_embedding_near_dedup,
    "op5_document_fingerprints": order_minhash.op5_document_fingerprints,
    "op4_sentencepiece": sentencepiece.op4_sentencepiece,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_warc": warc.op7_warc,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_pii_surrogates": pii.op10_pii_surrogates,
}

ORACLES = {"op3_embedding_near_dedup": embedding_dedup.OP3_SQL, "op7_warc": warc.OP7_SQL}
