"""Training-data operators for document collections; nothing else in the library imports this package."""
