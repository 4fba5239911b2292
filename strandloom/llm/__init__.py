"""Operators for building text-training corpora; nothing else in the library depends on them."""
