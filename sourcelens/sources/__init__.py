"""Where corpora come from."""
