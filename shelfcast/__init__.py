"""Probabilistic retail demand forecasting as Spark jobs over all series at once."""
