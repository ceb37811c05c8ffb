"""Training-data operators: mixing, near-duplicates, classifiers, secrets, HTML, tokens and nearest neighbours."""
