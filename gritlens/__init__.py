"""Source-code security analytics as Spark jobs.

Tables of source files go in; findings, scores, scan history, reports,
remediation text and evaluation figures come out as DataFrames.
"""
