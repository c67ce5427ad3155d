"""Declarative graph-rewrite rules over quads, compiled to Spark DataFrame plans."""
