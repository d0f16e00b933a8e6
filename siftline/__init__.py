"""siftline: auditing of embedding cohorts and preparation of training data, as Spark jobs."""

__version__ = "0.1.0"
