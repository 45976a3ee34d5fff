"""Column functions: chunking, hashing, names and the restore cost model."""
