"""Corpusloom: retrieval, evaluation and corpus-quality operators as lazy Spark DataFrame plans."""
