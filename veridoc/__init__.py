"""Veridoc: evidence-grounded document question answering as Spark DataFrame jobs."""
