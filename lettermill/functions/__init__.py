"""Column functions."""

from lettermill.functions.content import (
    binary_newlines,
    maildir_name,
    message_hash,
    message_length,
    normalise_newlines,
    split_message,
)
from lettermill.functions.text import imap_date, imap_quote, join_list, plural
from lettermill.functions.values import attrs_to_map, seconds_to_ns

__all__ = [
    "attrs_to_map",
    "binary_newlines",
    "imap_date",
    "imap_quote",
    "join_list",
    "maildir_name",
    "message_hash",
    "message_length",
    "normalise_newlines",
    "plural",
    "seconds_to_ns",
    "split_message",
]
