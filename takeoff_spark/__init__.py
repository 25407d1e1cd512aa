"""Construction take-off and budgeting as PySpark jobs: DataFrame in, DataFrame out."""
