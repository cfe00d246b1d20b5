"""Message content as column expressions.

Mail is not always valid UTF-8.  Binary content is moved through ISO-8859-1,
where every byte is one character, so no byte is lost or changed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BYTEWISE = "ISO-8859-1"


def normalise_newlines(text: Column) -> Column:
    """CR LF becomes LF in a STRING column; a lone CR stays."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def binary_newlines(raw: Column) -> Column:
    """CR LF becomes LF in a BINARY column; a lone CR stays."""
    return F.encode(normalise_newlines(F.decode(raw, _BYTEWISE)), _BYTEWISE)


def message_hash(header: Column, body: Column) -> Column:
    """SHA-256 (hex) over normalised header followed by normalised body."""
    return F.sha2(F.concat(header, body), 256)


def message_length(header: Column, body: Column) -> Column:
    """Length in bytes, not characters."""
    return (F.octet_length(header) + F.octet_length(body)).cast("bigint")


def maildir_name(msg_hash: Column, dup_no: Column, host: Column, length: Column) -> Column:
    return F.concat(
        F.lit("IAH_"), msg_hash, F.lit("_"), dup_no.cast("string"), F.lit("."), host,
        F.lit(",S="), length.cast("string"),
    )


def split_message(raw: Column) -> Column:
    """Struct ``(header, body)``; the header ends with the first blank line.

    The blank line may be LF LF or CR LF CR LF, or stand at the very start.
    Without a blank line everything is header.
    """
    text = F.decode(raw, _BYTEWISE)
    # Prefix one newline so that a leading blank line is found the same way.
    shifted = F.concat(F.lit("\n"), text)
    lf = F.instr(shifted, "\n\n")
    crlf = F.instr(shifted, "\n\r\n")
    total = F.length(text)
    lf_end = F.when(lf > 0, lf)
    crlf_end = F.when(crlf > 0, crlf + 1)
    end = F.coalesce(F.least(lf_end, crlf_end), total)
    return F.struct(
        F.encode(F.substring(text, F.lit(1), end), _BYTEWISE).alias("header"),
        F.encode(F.substring(text, end + 1, total), _BYTEWISE).alias("body"),
    )
