"""Compositions of operators: batch builds, stored tables, registered queries."""
