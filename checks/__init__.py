"""Test data and the independent SQL that results are compared with."""
