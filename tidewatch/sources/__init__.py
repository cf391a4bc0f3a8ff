"""Reading and writing: day-partitioned tables, rejects, contracts, retention."""
