"""The queries of the text operators, by name."""

from scoutline.llm import byte_bpe, exact_dedup, language_cnn, page_text, quality_cotraining, quality_rules, quote_threads, simhash_dedup, source_mixing, substring_dedup

_MODULES = (exact_dedup, quality_rules, quote_threads, language_cnn, substring_dedup, quality_cotraining, source_mixing, page_text, simhash_dedup, byte_bpe)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
