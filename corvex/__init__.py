"""Corvex: document, graph and activity analytics as Spark plans."""
