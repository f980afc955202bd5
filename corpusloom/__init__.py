"""Document corpora, retrieval indexes and batch question answering as Spark jobs."""

__version__ = "0.1.0"
