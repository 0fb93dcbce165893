"""Operators for preparing training text at scale: one module per operator, their queries in ``workload``.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
