"""Corpus operators: quality, dedup, personal data, decontamination, scoring, fixity, mixing, token files, URL rules."""
