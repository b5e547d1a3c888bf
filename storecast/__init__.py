"""storecast — weekly store-panel analytics as Spark DataFrame operators.

Every operator takes and returns Spark DataFrames. Heavy work runs as
Spark aggregates, joins and windows; Python (pandas/NumPy) only runs
inside tasks where Spark partitions the work (grouped maps over bounded
groups such as one weekly series or one tree's sub-sample).
"""

__version__ = "0.1.0"
