"""Corpus preparation operators; ``queries`` registers one query per operator."""
