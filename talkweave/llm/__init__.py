"""Training-data operators: the ten corpus components and their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
