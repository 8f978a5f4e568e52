"""Training-data operators: URL filters, HTML extraction, quality and language-model
scoring, source mixing, near-duplicates, repeated passages, secrets, decontamination
and document fingerprints.  Nothing else in the library imports this subpackage."""
