"""SQL logic tests: scripts of statements, queries and what they should give."""
