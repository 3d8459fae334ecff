"""Sedgeline: curation and summarising of messy attribute tables on PySpark."""
