"""The queries of the operators of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from filings.llm import abuse, leaks, lines, looks, sentences, split, tokens

QUERIES = {f.__name__: f for f in (lines.p1_found, lines.p1_sections, lines.p1_clusters, looks.p2_found, looks.p2_classes, looks.p2_sections, sentences.p3_found, sentences.p3_sentences, split.p5_found, split.p5_pieces, tokens.p6_tokens, tokens.p6_totals, tokens.p6_slices, tokens.p8_ids, leaks.p9_found, abuse.p10_found, abuse.p10_scores, abuse.p10_rates)}

SQL = {
    "p5_found": """
        SELECT 'filing_sections' AS table_name, section_id AS item_id FROM filing_sections WHERE length(content) > 2000
        UNION SELECT 'chunks', chunk_id FROM chunks WHERE length(content) > 2000""",
}
