"""Product evidence verdicts as PySpark DataFrame operators."""
