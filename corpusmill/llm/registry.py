"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from corpusmill.llm import conversations, decontaminate, htmltext, langid, licenses, linededup, mixing, pii, quality, simhash, spellings, substrings, warc

QUERIES = {"op2_language_id": langid.query,
           "op8_license_scan": licenses.query,
           "op7_html_extraction": htmltext.query,
           "op9_warc_revisits": warc.query,
           "op4_decontaminate": decontaminate.query, "op6_line_dedup": linededup.query,
           "op3_mix_sources": mixing.query, "op5_simhash_golay": simhash.query,
           "op1_personal_data": pii.query, "op10_quality_rules": quality.query,
           "op11_substring_dedup": substrings.query,
           "op12_spelling_variants": spellings.query, "op13_conversation_repair": conversations.query}


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": licenses.sql(), "op9_warc_revisits": warc.sql(), "op6_line_dedup": linededup.sql(), "op10_quality_rules": quality.sql(),
            "op11_substring_dedup": substrings.sql()}
