"""Contrast analytics as Spark DataFrame operators."""
