"""shoalwork: gridded-monitoring analytics as PySpark DataFrame operators."""
