"""The incremental form of enrichment."""
