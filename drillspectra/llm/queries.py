"""Imports every operator module, which registers its query."""

from . import edits, html_text, language, licenses, lines, mixing, near_copies, periodic, prefix_trie, secrets, tokens, topk, warc  # noqa: F401
from .common import QUERIES, SQL  # noqa: F401
