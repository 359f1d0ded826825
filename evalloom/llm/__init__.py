"""Operators for preparing language-model training data: every module here stands alone and none is imported by the rest of the library."""
