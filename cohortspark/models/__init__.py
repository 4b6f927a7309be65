"""Model training, scoring and explanation on Spark ML."""
