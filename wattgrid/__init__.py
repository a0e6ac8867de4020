"""Tariff analytics on Spark: operators are functions from DataFrame to DataFrame."""
