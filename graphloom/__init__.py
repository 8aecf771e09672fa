"""A Spark engine that turns tables and documents into an ontology-backed graph and a personal-data report."""
