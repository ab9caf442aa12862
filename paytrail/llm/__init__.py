"""Training-data operators over ``documents`` and ``embeddings``.

Nothing outside this folder (and the top-level ``corpus_pipeline.py``) imports it.
"""
