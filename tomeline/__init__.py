"""Campaign lore, session analytics and retrieval as Spark table operators."""
