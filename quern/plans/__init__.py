"""Compositions of operators: whole retrieval and import plans over batches."""
