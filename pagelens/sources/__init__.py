"""Where pages, nodes and styles come from."""
