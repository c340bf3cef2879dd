"""Series preparation, features and forecasting on Spark."""
