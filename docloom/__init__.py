"""Document analytics on Spark: sources, text operators, search, quality, graphs and streams as DataFrame transformations."""
