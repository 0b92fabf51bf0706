"""Queries over the filing tables of TESTDATA.md."""
