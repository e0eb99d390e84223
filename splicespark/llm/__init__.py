"""Training-data pipeline operators: deduplication, extraction, scoring, scanning, filtering, mixing and counting.

Nothing else in the library imports this subpackage.
"""
