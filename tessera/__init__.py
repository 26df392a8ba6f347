"""Curation of recurring searches as PySpark DataFrame transformations."""
