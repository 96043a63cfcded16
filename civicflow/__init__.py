"""civicflow: Spark-native analytics over city service-request data.

Every public function takes and returns a ``pyspark.sql.DataFrame``; the work
is declared with the DataFrame API and left to Catalyst/AQE to plan.
"""

__version__ = "0.1.0"
