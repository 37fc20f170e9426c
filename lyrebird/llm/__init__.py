"""Operators for building training corpora: filtering, de-duplication, masking, mixing, packing, storage and search."""
