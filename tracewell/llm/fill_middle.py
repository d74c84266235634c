"""Fill-in-middle samples: texts cut at token boundaries and put together in another order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import whole_text

#: Runs of ASCII letters and single other code points.
UNITS = "[A-Za-z]+|[^A-Za-z]"
TAGS = ("<P>", "<S>", "<M>")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")
#: Bytes of text that are cut into units at a time; a longer text goes alone.
SLICE_BYTES = 1 << 22


def _separator(texts: pa.Array) -> str:
    """A private-use code point, or two, that no text holds."""
    private = [chr(c) for c in chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE))]
    for mark in chain(private, map("".join, permutations(private, 2))):
        if not pc.any(pc.match_substring(texts, mark)).as_py():
            return mark
    raise ValueError("the texts hold every pair of private-use code points")


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Cuts a batch into parts of about SLICE_BYTES."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    part = np.concatenate([[0], ends[:-1]]) // SLICE_BYTES if len(ends) else ends
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ends)]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if a < b)


def _remainder(value: pa.Array, divisor: pa.Array) -> pa.Array:
    return pc.subtract(value, pc.multiply(pc.divide(value, divisor), divisor))


def _joined(values: pa.Array, counts: pa.Array) -> pa.Array:
    """Consecutive values put together, ``counts`` of them for each row."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts.to_numpy())]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), "")


def cut_and_order(texts: pa.Array, first: pa.Array, second: pa.Array, form: pa.Array) -> pa.StructArray:
    """n, form, code points of prefix and middle, and the output of each text; ``form`` is what a text that is not plain gets."""
    mark = _separator(texts)
    lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=UNITS, replacement=f"{mark}\\0"), mark)
    n = pc.subtract(pc.cast(pc.list_value_length(lists), "int64"), 1)  # what stands before the first mark is empty
    many = pc.add(n, 1)
    a, b = _remainder(first, many), _remainder(second, many)
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)

    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = pa.array(lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), "int64")
    ordinal = pc.subtract(pc.subtract(pa.array(np.arange(len(units)), "int64"), pc.take(starts, parent)), 1)
    to_low, to_high = pc.less(ordinal, pc.take(low, parent)), pc.less(ordinal, pc.take(high, parent))
    real = pc.greater_equal(ordinal, 0)
    prefix = _joined(pc.filter(units, pc.and_(real, to_low)), low)
    middle = _joined(pc.filter(units, pc.and_(pc.and_not(real, to_low), to_high)), pc.subtract(high, low))
    suffix = _joined(pc.filter(units, pc.and_not(real, to_high)), pc.subtract(n, high))

    held = [pc.match_substring(texts, tag) for tag in TAGS]
    plain = pc.or_(pc.or_(pc.equal(n, 0), held[0]), pc.or_(held[1], held[2]))
    form = pc.if_else(plain, "plain", form)
    plain = pc.equal(form, "plain")
    spm = pc.binary_join_element_wise(TAGS[1], suffix, TAGS[0], prefix, TAGS[2], middle, "")
    psm = pc.binary_join_element_wise(TAGS[0], prefix, TAGS[1], suffix, TAGS[2], middle, "")
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm, psm))
    chars = [pc.if_else(plain, pa.scalar(None, "int64"), pc.cast(pc.utf8_length(x), "int64")) for x in (prefix, middle)]
    return pa.StructArray.from_arrays([n, form, *chars, output], list(RESULTS))


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = "1",
                   plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output to every row.

    A whole text is cut into its ``n`` units. Four draws come from the SHA-256
    of ``seed``, a colon and the id: two cuts, taken modulo n + 1; whether the
    text stays plain (modulo 100, from ``plain_from``); whether the suffix
    goes first (modulo 100, below ``spm_below``). Empty texts and texts that
    hold a tag are plain, and a plain output is the text. A NULL text is an
    empty one, a NULL id counts as an empty string. Equal rows get equal
    results; rows of one id are cut each for itself. An empty table gives an
    empty result. Very long texts are handled alone, others a few megabytes
    at a time; no row leaves its place, so nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    form = F.when(draw[2] % 100 >= plain_from, "plain").when(draw[3] % 100 < spm_below, "spm").otherwise("psm")

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def pieces(texts: pa.Array, first: pa.Array, second: pa.Array, forms: pa.Array) -> pa.Array:
        done = [cut_and_order(*(pc.take(x, pa.array(np.arange(s.start, s.stop))) for x in (texts, first, second, forms))) for s in _slices(texts)]
        return pa.concat_arrays(done) if done else cut_and_order(texts, first, second, forms)

    made = docs.drop(*RESULTS).withColumn("_t_made", pieces(whole_text(text), draw[0], draw[1], form))
    return made.select("*", "_t_made.*").drop("_t_made")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; a text that is cut holds no tag, so each tag's first place is its own."""
    p, s, m = TAGS

    def between(body: Column, tag: str) -> tuple[Column, Column]:
        before = F.substring_index(body, tag, 1)
        return before, F.substring(body, F.length(before) + F.lit(len(tag) + 1), F.length(body))

    prefix, rest = between(F.substring(output, F.lit(len(p) + 1), F.length(output)), s)
    suffix, middle = between(rest, m)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = between(F.substring(output, F.lit(len(s) + 1), F.length(output)), p)
    prefix, middle = between(rest, m)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))
