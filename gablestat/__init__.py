"""Operators for yearly assessment snapshots, expressed as Spark DataFrame plans."""
