"""Loading of files tables."""
