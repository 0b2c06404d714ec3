"""Sample streams sealed into batches."""
