"""Strandline: Spark operators for large collections of ordered sequences and the tables that govern them."""
