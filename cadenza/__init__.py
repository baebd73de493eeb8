"""Cadenza: endurance time-series analytics and corpus preparation on Spark."""
