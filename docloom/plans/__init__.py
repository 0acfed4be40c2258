"""Plans: configuration and the document pipeline."""
