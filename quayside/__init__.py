"""Quayside: decision-experiment analytics as composable Spark DataFrame operators."""
