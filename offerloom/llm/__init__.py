"""Training-data operators: text, vectors, token sequences and their corpus pipeline."""
