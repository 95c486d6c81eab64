"""Value semantics of the query language as column expressions."""
