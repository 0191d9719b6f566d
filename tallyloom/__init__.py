"""Retail demand, inventory and forecast-scoring analytics on Spark."""
