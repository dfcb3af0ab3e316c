"""Training-data operators: PII, quality rules, byte-level BPE, LM scoring,
shard placement, repeated-passage removal, chat formatting, n-gram and
embedding near-duplicates, source mixing.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` refers to it.
"""
