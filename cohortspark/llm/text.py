"""Words, folds and row keys shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the contracts: what a word is.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; a text of single-byte characters takes the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def row_key(doc_id: Column, text: Column) -> Column:
    """What identifies a row whose id may be null or repeated: the id and a digest of the text."""
    return F.sha2(F.concat_ws("\x00", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))), 256)
