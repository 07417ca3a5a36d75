"""Operators for preparing large training corpora (see README, "Training-data operators").

Nothing outside this subpackage imports it; `queries.py` registers one query
per operator and `corpus_pipeline.py` chains five of them.
"""
