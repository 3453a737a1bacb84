"""Training-data operators over text, embedding and page tables.

Nothing outside this subpackage (and `corpus_pipeline.py`) imports it.
"""
