"""Spark jobs over long, coded event records per person."""
