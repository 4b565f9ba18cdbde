"""Sources: repository listings, chunkers and edge extractors."""
