"""Item-store analytics on Spark: key-condition reads, expressions, indexes, writes, change feeds, metrics, PartiQL."""
