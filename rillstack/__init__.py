"""Rillstack: signal, imaging and corpus analytics expressed as Spark DataFrame jobs."""
