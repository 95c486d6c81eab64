"""A versioned-document query engine on Spark."""
