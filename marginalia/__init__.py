"""Comment analytics on Spark DataFrames: find, report, remove and archive delimited comments."""

from marginalia.rules import CommentRules, JobConfig, PathRules

__all__ = ["CommentRules", "JobConfig", "PathRules"]
