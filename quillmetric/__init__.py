"""Engagement, contact and text analytics as PySpark DataFrame operators."""
