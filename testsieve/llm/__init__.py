"""Training-data operators: formatting, fingerprints, tokenising, scans, classifiers and duplicate search."""
