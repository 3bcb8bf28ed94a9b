"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from . import collocations, exact_dedup, mixing, near_dedup, packing, periodic_runs, quality, sentence_pieces, sharding, token_counts, token_files, topk, toxicity

MODULES = [mixing, topk, toxicity, near_dedup, quality, sharding, exact_dedup, packing, token_counts, token_files, sentence_pieces, collocations, periodic_runs]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
