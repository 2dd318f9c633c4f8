"""Product facts and training-data preparation on Spark."""
