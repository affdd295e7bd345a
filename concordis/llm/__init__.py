"""Training-data operators: quality, dedup, mixing, packing, scanning and archiving.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when present.
"""
