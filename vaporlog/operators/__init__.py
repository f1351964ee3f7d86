"""Dataset-level operators: table in, table out."""
