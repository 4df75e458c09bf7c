"""Telemetry detection and technique-progression analytics on Spark DataFrames."""
