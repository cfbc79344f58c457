"""Access-governance analytics over tool registries kept as Spark tables."""
