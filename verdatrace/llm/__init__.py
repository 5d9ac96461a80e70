"""Training-data operators: tokenising, filtering, deduplication and redaction of text corpora.

Nothing outside this subpackage imports it.  ``verdatrace.llm.queries`` holds
the thin queries (``op1_...`` to ``op10_...`` and ``pipeline``) that the entry
module registers when the subpackage can be imported.
"""
