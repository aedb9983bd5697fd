"""DataFrame operators over graphs, partitions and texts."""
