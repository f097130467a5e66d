"""The registered queries of the core, each over its whole tables."""

from retromill.queries import classes, families, files, intervals, problems, rounds, sequences, similarity, streams
from retromill.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "classes", "families", "files", "intervals", "problems", "rounds", "sequences", "similarity", "streams"]
