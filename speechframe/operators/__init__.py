"""DataFrame to DataFrame operators, keyed by recording."""
