"""Spark jobs for spatial expression tables, in long sparse form."""
