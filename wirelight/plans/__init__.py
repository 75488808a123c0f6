"""Worked queries over the star-schema tables, with equivalent SQL."""
