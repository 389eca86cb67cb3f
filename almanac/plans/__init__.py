"""The pipeline and the registered queries."""
