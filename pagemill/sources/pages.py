"""Texts set as pages of positioned words, over Arrow batches: input for the page layout where no PDF is at hand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are set together, and words of a longer text; both bound what is held beside the batch.
BYTES, WORDS = 1 << 20, 60_000
#: A page: lines of words; the lines with a running head, in large type, of code, and the first of the small ones.
LINES, ACROSS = 25, 8
HEAD, LARGE, CODE, SMALL = 0, 5, 10, 23
#: Bytes that part words.
GAPS = np.isin(np.arange(256), list(b"\t\n\f\r "))


def set_words(docs: pa.RecordBatch) -> Iterator[pa.Table]:
    """The words of texts (doc_key, text) as pages of 25 lines of eight words: a running head, a large line, a line of code, two small lines at
    the end. Each table holds whole pages, and every word of the texts is in one."""
    text = docs["text"].fill_null("").cast(pa.large_string())
    size = len(text)
    at = np.frombuffer(text.buffers()[1], dtype=np.int64, count=text.offset + size + 1)[text.offset :]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < size:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BYTES, "right")) - 1)
        raw, rows = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        gap = GAPS[raw]
        begins, ends = ~gap, ~gap
        new = np.zeros(len(raw) + 1, dtype=bool)
        new[rows] = True
        begins[1:] &= gap[:-1] | new[1:-1]
        ends[:-1] &= gap[1:] | new[1:-1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first = np.searchsorted(begins, rows)  # word of each text
        per = LINES * ACROSS
        cut = WORDS // per * per if hi - lo == 1 else max(1, len(begins))
        for a in range(0, len(begins), cut):
            b = min(len(begins), a + cut)
            own = np.repeat(np.arange(lo, hi), np.diff(np.clip(first, a, b)))
            seq = np.arange(a, b) - first[own - lo]
            size_of = np.append(0, np.cumsum(ends[a:b] - begins[a:b]))
            here = slice(begins[a], ends[b - 1])
            words = pa.StringArray.from_buffers(b - a, pa.py_buffer(size_of.astype(np.int32)), pa.py_buffer(raw[here][~gap[here]]))
            yield _set(docs["doc_key"].take(pa.array(own)), seq, words)
        lo = hi


def _set(doc: pa.Array, seq: np.ndarray, words: pa.Array) -> pa.Table:
    line, at = seq // ACROSS % LINES, seq % ACROSS
    head = line == HEAD
    if head.any():
        heads = pa.array([f"Head{i}" for i in range(ACROSS)])
        words = pc.replace_with_mask(words, pa.array(head), heads.take(pa.array(at[head])))
    size = np.where(line == LARGE, 18.0, np.where(line >= SMALL, 7.0, 10.0))
    top = line * 24.0 + np.where(line >= SMALL, 20.0, 0.0)
    x0 = at * 50.0
    font = pa.DictionaryArray.from_arrays(pa.array((line == CODE).astype(np.int8)), pa.array(["Times", "Courier"]))
    page = (seq // (LINES * ACROSS) + 1).astype(np.int32)
    return pa.table({"doc_key": doc, "page_number": page, "word_seq": seq.astype(np.int32), "text": words, "x0": x0, "x1": x0 + 40, "top": top, "bottom": top + size, "fontname": font, "size": size})
