"""Scholarly analytics on Spark.

Text cleaning, paper and author entity resolution, topic assignment and
labelling, dimensional load, co-authorship network, search, profile and
trend queries, all expressed as Spark DataFrame plans.
"""

from scriptorium.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
