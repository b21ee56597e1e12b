"""Expressions over words and sentences; Unicode classes spelled out so that engines agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word is made of, and white space as Unicode has it.
LETTER = r"[\p{L}\p{N}_]"
SIGN = r"[^\p{L}\p{N}_]"
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BOS, EOS, UNK = "<s>", "</s>", "<unk>"


def clean_cell(c: Column) -> Column:
    """A raw cell; a lone dot is missing."""
    return F.nullif(c.cast("string"), F.lit("."))


def clean_word(w: Column) -> Column:
    """A word without the signs around it; inner apostrophes and hyphens stay, a null is empty."""
    return F.coalesce(F.regexp_replace(w.cast("string"), f"^{SIGN}+|{SIGN}+$", ""), F.lit(""))


def punctuation_only(w: Column) -> Column:
    """Whether there are signs besides white space and nothing else; false for nothing."""
    w = w.cast("string")  # most words have a letter at once, which settles it
    return F.coalesce(~w.rlike(LETTER) & w.rlike(f"[^{SPACE[1:]}"), F.lit(False))


def has_alnum(w: Column) -> Column:
    return F.coalesce(w.cast("string").rlike("[A-Za-z0-9]"), F.lit(False))


def ascii_clean(w: Column) -> Column:
    """Lower case without anything but a-z, 0-9 and apostrophes."""
    return F.regexp_replace(F.lower(w), "[^a-z0-9']", "")


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def padded(words: Column, order: int) -> Column:
    """A sentence with order - 1 begins and one end."""
    return F.concat(F.array_repeat(F.lit(BOS), order - 1), words, F.array(F.lit(EOS)))


def sentence_key(c: Column) -> Column:
    """A sentence's id as text, by which groups are told apart."""
    return c.cast("string")


def composite_key(*parts: Column) -> Column:
    """Parts joined by a hyphen; null if one is."""
    out: list[Column] = []
    for p in parts:
        out += [F.lit("-"), p.cast("string")]
    return F.concat(*out[1:])


def _spans(lengths: pa.Array) -> pa.Array:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lengths), 0).to_numpy().astype(np.int64))
    n = pc.fill_null(lengths.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.concatenate([[0], ends])
    before = np.concatenate([[0], np.cumsum(n + 1)])
    start = before[:-1] - np.repeat(before[begins[:-1]], np.diff(begins))
    spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start, start + n)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), spans)


def word_spans(words: Column) -> Column:
    """(start, end) of each word in the sentence that joins them by spaces, in characters."""
    return F.arrow_udf(_spans, "array<struct<start: int, end: int>>")(F.transform(words, lambda w: F.length(w)))
