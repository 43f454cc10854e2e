"""Hypergraph analytics and text-data operators as Spark DataFrame plans."""
