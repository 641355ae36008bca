"""Operators for preparing training data, written for large Spark clusters."""
