"""Spark-first analytics over messy tables and agent trajectories."""
