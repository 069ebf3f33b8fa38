"""The queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from heliograph.llm.ann import op4_cross_polytope
from heliograph.llm.decontaminate import SQL as NGRAM_SQL
from heliograph.llm.decontaminate import op3_benchmark_ngrams
from heliograph.llm.language_id import op8_kneser_ney
from heliograph.llm.line_dedup import SQL as LINE_SQL
from heliograph.llm.line_dedup import op7_line_templates
from heliograph.llm.merkle import SQL as MERKLE_SQL
from heliograph.llm.merkle import op12_merkle_manifest
from heliograph.llm.packing import op5_vector_packing
from heliograph.llm.quotes import SQL as QUOTE_SQL
from heliograph.llm.quotes import op1_quotation_links
from heliograph.llm.sharding import op2_sampled_splitters
from heliograph.llm.simhash import op6_byte_position_simhash
from heliograph.llm.token_counts import op10_pretoken_counts
from heliograph.llm.toxicity import op13_compression_toxicity
from heliograph.llm.vector_codes import SQL as CODE_SQL
from heliograph.llm.vector_codes import op11_exponion_codes
from heliograph.llm.warc import SQL as WARC_SQL
from heliograph.llm.warc import op9_gzip_normaliser

QUERIES = {
    f.__name__: f
    for f in (
        op1_quotation_links,
        op2_sampled_splitters,
        op3_benchmark_ngrams,
        op4_cross_polytope,
        op5_vector_packing,
        op6_byte_position_simhash,
        op7_line_templates,
        op8_kneser_ney,
        op9_gzip_normaliser,
        op10_pretoken_counts,
        op11_exponion_codes,
        op12_merkle_manifest,
        op13_compression_toxicity,
    )
}
SQL: dict[str, str] = {
    op1_quotation_links.__name__: QUOTE_SQL,
    op3_benchmark_ngrams.__name__: NGRAM_SQL,
    op7_line_templates.__name__: LINE_SQL,
    op9_gzip_normaliser.__name__: WARC_SQL,
    op11_exponion_codes.__name__: CODE_SQL,
    op12_merkle_manifest.__name__: MERKLE_SQL,
}
