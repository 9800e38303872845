"""Training-data pipeline operators (WARC derivatives, decontamination, scoring, fingerprints, mixing, classifiers)."""
