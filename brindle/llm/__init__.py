"""Training-data operators: ten whole-table operators and their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
