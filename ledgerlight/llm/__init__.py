"""Training-data operators: language ID, secret scan, quality, dedup, extraction, decontamination, PII, mixing, neighbours, runs
of words, conversation trie.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
