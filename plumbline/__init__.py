"""Replicate-noise analytics expressed as Spark DataFrame plans."""
