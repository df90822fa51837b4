"""Mixture analytics on Spark: fractions, solutions, scores, variants, reads."""
