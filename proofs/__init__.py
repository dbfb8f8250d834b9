"""Named queries over the given tables, each with an independent SQL twin where one exists."""
