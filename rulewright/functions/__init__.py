"""Terms, templates and expressions."""
