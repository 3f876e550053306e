"""From query text to a syntax tree and on to a DataFrame plan."""
