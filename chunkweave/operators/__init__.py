"""DataFrame operators of the chunk catalog, deduplication, placement and restore."""
