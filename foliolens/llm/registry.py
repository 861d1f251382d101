"""The queries of this subpackage and the SQL that they are held against."""

from foliolens.llm import chat, classifier, decontamination, html_text, pieces, pitman_yor, quality_rules, simhash, url_filters, warc

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_warc": warc.op2_warc,
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_lm_scoring": pitman_yor.op4_lm_scoring,
    "op5_quality_classifier": classifier.op5_quality_classifier,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_benchmark_decontamination": decontamination.op9_benchmark_decontamination,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}
SQL = {"op1_url_filters": url_filters.SQL, "op2_warc": warc.SQL, "op6_chat_formatting": chat.SQL}
