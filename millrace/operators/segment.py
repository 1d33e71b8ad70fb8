"""Words of texts by a dictionary: the best path through the lattice of all dictionary words of a run of letters.

A run is what stands between characters that no word has. Its lattice has an edge for each dictionary word that stands in it, and one for each
single character. The path of the greatest product of frequencies is found from the end to the front, one step a character. The dictionary is
a table of words and their frequencies; it is broadcast, and its size is checked before.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a dictionary at most, and characters of a word; what is more stops the job, as nothing may be left out.
MAX_WORDS, MAX_LENGTH = 2_000_000, 64


class Dictionary:
    """Words with the logarithm of their share of all frequencies. A character that is no word counts as a word of frequency 1."""

    def __init__(self, frequencies: dict[str, float]) -> None:
        total = math.log(sum(frequencies.values()) or 1.0)
        self.share = {w: math.log(f) - total for w, f in frequencies.items() if w and f > 0}
        self.unknown = -total
        self.longest: dict[str, int] = {}
        for w in self.share:
            self.longest[w[0]] = max(self.longest.get(w[0], 1), len(w))

    def cut(self, run: str) -> list[str]:
        """The words of the best path; of equal paths that with the longer word first, read from the front."""
        n = len(run)
        best, step = [0.0] * (n + 1), [1] * (n + 1)
        share, unknown = self.share, self.unknown
        for i in range(n - 1, -1, -1):
            top, size = share.get(run[i], unknown) + best[i + 1], 1
            for k in range(2, min(self.longest.get(run[i], 1), n - i) + 1):
                own = share.get(run[i : i + k])
                # Sums in another order may differ by rounding, which must not decide.
                if own is not None and own + best[i + k] >= top - 1e-9:
                    top, size = own + best[i + k], k
            best[i], step[i] = top, size
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


def dictionary(words: DataFrame, word: str = "word", frequency: str = "n") -> Dictionary:
    """The dictionary of a table; rows of one word add up, null and empty words and frequencies of 0 or less don't count."""
    d = words.where(F.col(word).isNotNull() & (F.col(word) != "") & (F.col(frequency) > 0)).groupBy(F.col(word).alias("w")).agg(F.sum(frequency).cast("double").alias("f"))
    size = d.agg(F.count("*").alias("n"), F.max(F.length("w")).alias("longest")).first()
    if size.n > MAX_WORDS or (size.longest or 0) > MAX_LENGTH:
        raise ValueError(f"a dictionary may have {MAX_WORDS} words of {MAX_LENGTH} characters at most, this one has {size.n} of up to {size.longest}")
    return Dictionary({r.w: r.f for r in d.toLocalIterator()})


def segmented(docs: DataFrame, key: str, text: str, words: Dictionary, letters: str = r"[^\W\d_]+") -> DataFrame:
    """Rows ``(key, tokens)``, one per row of ``docs``: the words of each run of ``letters`` of the lower-cased text, in order. Null: none."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, known = re.compile(letters), {}
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                tokens = []
                for t in part["text"].to_pylist():
                    own: list[str] = []
                    for r in pattern.findall((t or "").lower()):
                        # Runs of languages with spaces are words that come again and again.
                        if len(r) <= 32:
                            if r not in known:
                                if len(known) >= 1 << 16:
                                    known.clear()
                                known[r] = shared.value.cut(r)
                            own += known[r]
                        else:
                            own += shared.value.cut(r)
                    tokens.append(own)
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(tokens, pa.list_(pa.string()))], names=["key", "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, tokens array<string>").withColumnRenamed("key", key)


def content_tokens(tokens: Column, stop: Column | None = None) -> Column:
    """Tokens of two characters or more that are not all digits, white space and signs, without those of the array ``stop``."""
    own = F.filter(tokens, lambda t: (F.length(t) > 1) & t.rlike(r"[^\d\s\p{P}\p{S}]|_"))
    return own if stop is None else F.filter(own, lambda t: ~F.array_contains(stop, t))
