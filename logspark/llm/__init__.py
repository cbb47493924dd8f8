"""Operators for preparing training text: deduplication, decontamination,
licence and toxicity scans, mixing, chat and HTML clean-up, token counts.

Nothing outside this folder imports it.  ``queries.py`` registers one query
per operator; ``/corpus_pipeline.py`` chains five of them.
"""
