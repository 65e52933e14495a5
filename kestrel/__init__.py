"""kestrel: incident and log analytics as Spark DataFrame operators.

Every operator is a plain function that takes DataFrames (and parameters)
and returns a DataFrame; no operator creates or owns a SparkSession.
"""

__version__ = "0.1.0"
