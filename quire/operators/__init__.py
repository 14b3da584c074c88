"""Relational operators over blocks, floats, references and scores."""
