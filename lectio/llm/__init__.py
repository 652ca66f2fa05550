"""Training-data operators: extraction, near-duplicates, search, privacy, mixing, tokens, quality.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
