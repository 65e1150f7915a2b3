"""Main text of web pages: a tolerant tree, boosted trees over its nodes, and hierarchical decoding."""
