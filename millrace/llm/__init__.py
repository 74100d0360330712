"""Operators for preparing training data. Nothing outside this subpackage imports it but the entry module, if it is there."""
