"""Rules: their declaration, their checks, and the plans they compile to."""
