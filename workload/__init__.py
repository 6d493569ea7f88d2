"""The registered queries: inputs projected from the supplied tables, and their SQL."""
