"""Operators for large text corpora: labels, copies, filters, mixing, packing, search and archives."""
