"""Queries and SQL of this package."""

from pagewright.llm import conversation_repair, conversation_trie, decontaminate, license_scan, line_dedup, near_dedup, pii, quality_classifier, quality_rules, sentencepiece, toxicity, url_filter, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_pii": pii.op2_pii,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_sentencepiece": sentencepiece.op5_sentencepiece,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_warc": warc.op9_warc,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
    "pipeline": pipeline,
}
ORACLES = {"op3_decontaminate": decontaminate.OP3_SQL, "op7_line_dedup": line_dedup.OP7_SQL, "op10_url_filter": url_filter.OP10_SQL, "op12_conversation_repair": conversation_repair.OP12_SQL, "op13_conversation_trie": conversation_trie.OP13_SQL}
