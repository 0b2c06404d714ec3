"""Array stores: metadata, shard indexes, codecs, readers and writers."""
