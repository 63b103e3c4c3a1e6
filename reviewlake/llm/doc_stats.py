"""Statistics of whole texts, one row per document, computed in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import text_key, utf8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_top", "n_upper", "n_digits", "n_marks", "n_bangs", "n_short", "n_numbered", "longest_run", "n_stops"]
SCHEMA = ", ".join(f"{c} long" for c in COUNTS + MORE)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TAIL = (np.arange(256) & 0xC0) == 0x80  # continuation bytes of UTF-8
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MARK = np.isin(np.arange(256), list(b"!\"'()+,-./:;=?@[\\]^_`{}~"))


def text_stats(raw: bytes) -> list[int]:
    """The statistics of one text in SCHEMA's order; an empty text has zeros."""
    words = raw.split()  # bytes.split() cuts at exactly space and 09 to 0D
    n = len(words)
    if not n:
        return [0] * (len(COUNTS) + len(MORE))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeated = 0
    if n > 3:
        v = len(index)
        pairs = ids[:-1] * v + ids[1:]
        if v < 2_000_000:
            windows = pairs[:-1] * v + ids[2:]
        else:  # rank the pairs first, so the code fits in 64 bits
            windows = np.unique(pairs, return_inverse=True)[1][:-1] * np.int64(v) + ids[2:]
        _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
        hit = times[back] > 1
        if hit.any():
            covered = np.zeros(n, bool)
            covered[:-2] |= hit
            covered[1:-1] |= hit
            covered[2:] |= hit
            repeated = int(covered.sum())
    change = np.flatnonzero(np.diff(ids)) + 1
    runs = np.diff(np.concatenate(([0], change, [n])))
    times = np.bincount(ids)
    return [
        n, int(len(raw) - seen[_TAIL].sum() - seen[_SPACE].sum()), int(seen[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated,
        len(lines), len(index), int(times.max()), int(seen[65:91].sum()), int(seen[48:58].sum()), int(seen[_MARK].sum()), int(seen[33]),
        sum(len(w) < 4 for w in index), sum(len(x.split(None, 4)) < 5 for x in lines), int(runs.max()), sum(w.endswith((b".", b"?", b"!")) for w in index),
    ]


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_key (a hash of the text) and the statistics of every row; null text counts as empty."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = COUNTS + MORE
        for b in batches:
            rows = np.array([text_stats(x) for x in b.column(2).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, rows.T.copy())], [id_col, "text_key", *names])

    return docs.select(F.col(id_col), text_key(text_col), utf8(text_col).alias("t")).mapInArrow(run, f"{id_col} {kind}, text_key long, {SCHEMA}")


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Scale-free features by name: what a rule's threshold or the discriminant sees.
def features() -> dict[str, Column]:
    n, chars, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols_a_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "mark_share": F.col("n_marks") / chars,
        "bangs_a_word": F.col("n_bangs") / n,
        "distinct_share": F.col("n_distinct") / n,
        "top_share": F.col("n_top") / n,
        "words_a_line": n / lines,
        "short_line_share": F.col("n_numbered") / lines,
        "run_share": F.col("longest_run") / n,
        "stops_a_word": F.col("n_stops") / n,
    }
