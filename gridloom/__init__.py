"""Pixel-grid and colour-inventory analytics as Spark DataFrame jobs."""
