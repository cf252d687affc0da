"""Training-data operators: optional, imported by nothing else in the library."""
