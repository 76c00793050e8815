"""Property graphs as node and edge tables."""
