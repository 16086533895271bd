"""Named queries over the sample tables, each with equivalent SQL."""
