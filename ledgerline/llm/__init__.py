"""Operations of a training-data pipeline, as Spark jobs.

Nothing outside this package, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
