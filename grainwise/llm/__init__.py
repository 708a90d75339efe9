"""Training-data operators: tokenizers, archives, near duplicates, filters, secrets, formatting and classifiers."""
