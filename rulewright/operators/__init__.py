"""Running rules: firings, rewrites, fixpoints, sets, undo, history and the text facade."""
