"""The query catalogue: each operator over the driver tables, and the same in SQL."""
