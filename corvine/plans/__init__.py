"""Query-level plans: hybrid search, catalogue, section and version tools."""
