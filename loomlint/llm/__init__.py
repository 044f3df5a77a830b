"""Operators for preparing large training corpora.  Nothing else in loomlint imports this subpackage."""
