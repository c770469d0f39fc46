"""Reading and writing graphs."""
