from .tables import read_split, read_table, write_features

__all__ = ["read_split", "read_table", "write_features"]
