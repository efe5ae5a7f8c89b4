"""Evaluator-comparison analytics expressed as Spark DataFrame plans."""
