"""Column functions on any DataFrame: text scores, and normal and Student probabilities."""
