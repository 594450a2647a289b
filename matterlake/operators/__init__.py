"""DataFrame operators: one module per group of related operators."""
