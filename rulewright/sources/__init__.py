"""RDF documents, the quad store and tabular sources."""
