"""Training-data operators (packing, extraction, dedup, scoring, search).

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries only if it can be imported.
"""
