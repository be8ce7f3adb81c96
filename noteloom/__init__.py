"""Evidence retrieval and index maintenance over note corpora, as Spark jobs."""

from noteloom.session import get_spark

__all__ = ["get_spark"]
