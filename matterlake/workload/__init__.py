"""The operators bound to the benchmark tables, with equivalent SQL."""
