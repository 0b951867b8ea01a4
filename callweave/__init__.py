"""Contact-centre analytics, document preparation and retrieval on Spark."""
