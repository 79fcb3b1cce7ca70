"""Document processing on Spark: blocks, chunks, masking, validation, layout analytics, read model."""
