"""Set-at-a-time retrieval analytics on Spark."""
