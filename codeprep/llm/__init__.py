"""Operators of a training-data pipeline, one module per operator.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
