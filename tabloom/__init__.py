"""Tabular analytics and classic machine learning as Spark DataFrame jobs."""
