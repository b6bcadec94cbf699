"""The queries of this subpackage and, where SQL can express them, their SQL."""

from waymark.llm import ann, bytebpe, dialogs, extract, langid, linededup, mixing, neardup, negatives, pieces, quality, simhash, toxicity


def queries():
    return {
        "op1_quality": quality.op1_quality,
        "op2_near_vectors": neardup.op2_near_vectors,
        "op5_nearest": ann.op5_nearest,
        "op6_html_text": extract.op6_html_text,
        "op7_pieces": pieces.op7_pieces,
        "op8_language": langid.op8_language,
        "op4_toxicity": toxicity.op4_toxicity,
        "op3_line_dedup": linededup.op3_line_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_conversation_repair": dialogs.op11_conversation_repair,
        "op12_byte_bpe": bytebpe.op12_byte_bpe,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql():
    return {"op10_mix_sources": mixing.SQL, "op13_hard_negatives": negatives.SQL}
