"""Tree-aware sequence features as Spark DataFrame jobs.

Subpackages:
  sources    reading and writing split tables
  functions  column-level helpers (seeded draws, array text, batched maps)
  operators  tree walks, sequence features, masking, vectors, splits, metrics
  plans      named end-to-end queries over the test tables (+ DuckDB oracle SQL)
  streaming  the per-row feature steps applied to a file stream
"""

__all__ = ["session"]
