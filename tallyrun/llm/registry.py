"""The queries of this subpackage and their SQL."""

from . import huffman, language, merkle, mixing, near_vectors, packing, paragraphs, quality, simhash, spelling, suffix_dedup, token_count, topk

_MODULES = (token_count, mixing, huffman, suffix_dedup, language, paragraphs, quality, packing, topk, simhash, spelling, merkle, near_vectors)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
