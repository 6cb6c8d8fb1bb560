"""Plans: cutting lineage, the catalogue of queries, the whole analysis."""
