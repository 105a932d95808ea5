"""Monthly energy-consumption panels, models and predictions on Spark."""
