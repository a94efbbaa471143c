"""Job-posting screening as Spark jobs.

Every job is a function from DataFrames to a DataFrame. See README.md for the
list of jobs and for the rules they share.
"""

from postvet.session import build_session, configure

__all__ = ["build_session", "configure"]
