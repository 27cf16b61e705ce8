"""Where the vocabulary files of public tokenizers are; every function that needs one takes its path."""

from __future__ import annotations


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
