"""Cutting text where a byte-level pre-tokenizer always cuts, so that parts can be encoded once."""
from __future__ import annotations


def regular(part: str) -> bool:
    """Whether a blank-separated part, with the blank before it, is a unit of its own.

    The usual byte-level pattern opens a word with one blank, so a blank between two characters
    that are not white space starts a new pre-token. A part that is empty or begins with white
    space breaks that rule.
    """
    return part != "" and not part[0].isspace()
