"""Plain versions that several tests share."""

from test_selection import plain_targets, words
from test_texts import brute_links

__all__ = ["brute_links", "plain_targets", "words"]
