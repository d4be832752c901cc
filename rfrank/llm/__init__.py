"""Training-data operators: mixing, filtering, deduplication, extraction, formatting and packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
