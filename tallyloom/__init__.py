"""Cross-store price intelligence on Spark: sources, operators, functions, plans and streams."""
