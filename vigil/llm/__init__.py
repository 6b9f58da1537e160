"""Training-data operators: quality, extraction, archives, search, tokens, deduplication and mixing.

Nothing outside this subpackage imports it; `vigil.llm.queries` registers its queries.
"""
