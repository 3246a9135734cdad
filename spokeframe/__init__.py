"""Trajectory and ride analytics as Spark jobs."""
