"""Traffic-camera safety analytics as PySpark DataFrame operators."""
