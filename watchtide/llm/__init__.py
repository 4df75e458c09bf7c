"""Training-data operators: ten distributed jobs over documents, embeddings and conversations."""
