"""culprit: root-cause triage of failed data tests as Spark jobs.

A fleet of failing tests goes in as DataFrames; ranked causes, verdicts and
incidents come out as DataFrames.  Nothing in the library runs an action except
the store, the stream sink and the calibration fit.
"""

__version__ = "0.1.0"
