"""Line-first cleaning: lines that fail a rule go, then documents that lost too much of their text.

Line rules look at one line at a time: punctuation (a line of mostly marks), navigation (a row of short entries between
separators), boilerplate (licence, copyright, cookie and login notices), shouting, symbol clutter and repeats of a
line in the same document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, in_arrow

SYMBOLS = "#*$%&|<>"
#: Base rule of the contract: least words; percent of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Method's rule: share of the word characters that may be lost with failing lines.
MAX_LOST = 0.5
#: Words of a line that one notice accounts for.
NOTICE_WORDS = 40
#: Notices whose line is boilerplate.
BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|copyright (?:\(c\)|©|[0-9]{4})|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies"
    r"|sign (?:in|up) to|log ?in to continue|subscribe to our|click here|enable javascript|lorem ipsum",
    re.I,
)
SEPARATORS = re.compile(r"\s[|»›•·>]\s")


def line_fails(line: str) -> str | None:
    """The rule that a line with words fails, or None."""
    words = line.split()
    # A notice makes a line of ordinary length boilerplate; a longer line needs as many more.
    if NOTICE_WORDS * len(BOILERPLATE.findall(line)) >= len(words):
        return "boilerplate"
    pieces = SEPARATORS.split(line)
    if len(pieces) >= 3 and len(words) <= 6 * len(pieces):
        return "navigation"
    letters = sum(map(str.isalpha, line))
    if letters < 0.5 * (len(line) - line.count(" ")):
        return "punctuation"
    if sum(w.endswith(("###", "***", "$$$", "%%%", "&&&")) or w.startswith(("{", "<")) for w in words) > 0.3 * len(words):
        return "symbols"
    if len(words) >= 5 and sum(w.endswith("!!") and w.upper() == w for w in words) > 0.5 * len(words):
        return "shouting"
    return None


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = {w: 0 for w in words}
    if len(ids) == len(words):
        return 0
    for i, w in enumerate(ids):
        ids[w] = i
    x = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    key, size = x[:n].copy(), len(ids)
    for k in range(1, window):
        if size * len(ids) >= 1 << 62:  # rank anew so that the pair fits
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * len(ids) + x[k : n + k], size * len(ids)
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.nonzero(count[back] > 1)[0]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def assess(text: str | None) -> dict:
    """Base counts, the base verdict, the method's verdict and the text that is left."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    repeats = repeat_words(words)
    lines, seen, dup, kept, lost, chars = text.split("\n"), set(), 0, [], 0, 0
    for line in lines:
        inner = line.strip(SPACES)
        if not inner:
            kept.append(line)
            continue
        n = len(inner)
        chars += n
        again = line in seen
        seen.add(line)
        dup += again
        if again or line_fails(inner):
            lost += n
        else:
            kept.append(line)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    return {
        "n_words": len(words), "word_chars": len(text) - sum(map(text.count, SPACES)), "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup, "n_repeat_words": repeats, "base_failed": failed,
        "kept": not failed and lost <= MAX_LOST * chars, "lost": lost / chars if chars else 0.0, "cleaned": "\n".join(kept),
    }


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost double"


def clean(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs (doc_id, text): a row for each with counts, verdicts, and the cleaned text.

    Null and empty texts have no words and fail the base rule. Rows are treated alone, so null and repeated ids stay and
    ties need no care; of equal lines the first stays; a very long text is read whole; other columns are not read; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [assess(t) for t in b.column(1).to_pylist()]
            names = [f.split()[0] for f in FIELDS.split(", ")] + ["cleaned"] * with_text
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], {"lost": pa.float64(), "cleaned": pa.string(), "kept": pa.bool_(), "base_failed": pa.bool_()}.get(k, pa.int64())) for k in names)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, {FIELDS}" + ", cleaned string" * with_text)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its counts and whether it is kept."""
    return clean(documents(spark, sf_dir), with_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost", 6).alias("lost"))
