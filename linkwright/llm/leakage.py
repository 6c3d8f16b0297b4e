"""Test passages inside a corpus: an FM-index for each shard of the texts, searched backwards for every phrase."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.lookalikes import Rewriter, frequencies, rewriting

WORD = re.compile(r"[^\W_]+")
PHRASE = 12
#: A shard's index is built as soon as it holds so many words; one longer text makes a shard of its own.
SHARD_WORDS = 1_000_000
#: Every so-manieth text position is kept with the index.
SAMPLE = 16
MOST_PASSAGES = 200_000


class WaveletMatrix:
    """Ranks over a sequence of small numbers: a bit vector for each bit, most significant first, with counts each 64 bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits, self.words, self.before, self.zeros = len(values), bits, [], [], []
        at = values
        for b in range(bits - 1, -1, -1):
            bit = ((at >> b) & 1).astype(bool)
            packed = np.zeros(-(-(self.n + 1) // 64) * 8, dtype="uint8")
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            word = packed.view("<u8")
            self.words.append(word)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype="int64")]))
            self.zeros.append(int(self.n - bit.sum()))
            at = np.concatenate([at[~bit], at[bit]])

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits before i at a level."""
        block, rest = i >> 6, (i & 63).astype("uint64")
        mask = (np.uint64(1) << rest) - np.uint64(1)
        word = self.words[level][np.minimum(block, len(self.words[level]) - 1)]
        return self.before[level][block] + np.bitwise_count(word & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i, for arrays of both."""
        lo, hi = np.zeros_like(i), i.copy()
        for level in range(self.bits):
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self.ones(level, lo), self.ones(level, hi)
            lo = np.where(one, self.zeros[level] + a, lo - a)
            hi = np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at i."""
        i, c = i.copy(), np.zeros_like(i)
        for level in range(self.bits):
            word = self.words[level][i >> 6]
            one = ((word >> (i & 63).astype("uint64")) & np.uint64(1)).astype(bool)
            ones = self.ones(level, i)
            i = np.where(one, self.zeros[level] + ones, i - ones)
            c = (c << 1) | one
        return c


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling on the ranks that still tie."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable")
    first = np.concatenate([[True], seq[sa][1:] != seq[sa][:-1]])
    rank = np.empty(n, dtype="int64")
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    k = 1
    while True:
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, n))
        tied = np.repeat(sizes > 1, sizes)
        if not tied.any():
            return sa
        slots = np.flatnonzero(tied)
        pos = sa[slots]
        nxt = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)], -1)
        own = rank[pos]
        order = np.lexsort((nxt, own))
        sa[slots] = pos = pos[order]
        own, nxt = own[order], nxt[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        first[slots] |= new
        rank[pos] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        k *= 2


class FMIndex:
    """Backward search over a sequence of numbers in which ends[i] closes the i-th text; an end is smaller than all else and ends sort by text."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(seq)
        # For sorting every end is a symbol of its own, so no comparison runs on into the next text.
        ends = seq == 0
        keys = np.where(ends, np.cumsum(ends) - 1, seq + int(ends.sum()))
        sa = suffix_array(keys)
        bwt = seq[sa - 1]
        self.n, self.wm = n, WaveletMatrix(bwt, max(1, int(sigma - 1).bit_length()))
        self.c = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        # Ends are one number to the wavelet matrix, so no step may lead over one: the first word of each text is kept too.
        self.marked = (sa % sample == 0) | np.concatenate([[True], ends[:-1]])[sa]
        self.before = np.concatenate([[0], np.cumsum(self.marked)])
        self.kept = sa[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each pattern (one a row, all of one length)."""
        lo, hi = np.zeros(len(patterns), dtype="int64"), np.full(len(patterns), self.n, dtype="int64")
        live = np.arange(len(patterns))
        for col in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, col]
            lo[live] = self.c[c] + self.wm.rank(c, lo[live])
            hi[live] = self.c[c] + self.wm.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        alive = np.zeros(len(patterns), dtype=bool)
        alive[live] = True
        return np.where(alive, lo, 0), np.where(alive, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: steps back to the next sampled position, at the latest the first word of the text."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), dtype="int64"), np.full(len(rows), -1, dtype="int64")
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            hit = self.marked[at]
            done = live[hit]
            out[done] = self.kept[self.before[rows[done]]] + steps[done]
            live = live[~hit]
            at = rows[live]
            c = self.wm.access(at)
            rows[live] = self.c[c] + self.wm.rank(c, at)
            steps[live] += 1
        return out


def words_in(text: str, form) -> list[tuple[str, int, int]]:
    """Words in lower case with their place in the consistent form of the text."""
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(form(text).lower())]


def leaks(docs: DataFrame, passages: DataFrame, phrase: int = PHRASE, shard_words: int = SHARD_WORDS, doc_id: str = "doc_id", text: str = "text", eval_id: str = "eval_id", passage: str = "passage") -> DataFrame:
    """(doc_id, eval_id, first_word, last_word, start, stop): stretches of the documents that are in the passages.

    Every run of `phrase` consecutive words that document and passage have in
    common is found; runs that touch or overlap are merged into one span, given
    as numbers of words (from 0, both included) and as characters of the
    document's consistent form in lower case. Words are runs of letters and
    digits; letter case, punctuation and look-alike characters don't count.

    The passages are a bounded list and go to every task as phrases of word
    numbers; words of no passage are one number, so the alphabet stays small.
    Each task puts its documents into shards of about shard_words words, builds
    an FM-index of each (suffix order, wavelet ranks of the preceding words,
    sampled positions), searches all phrases backwards at once and locates the
    hits. Nothing is shuffled and no document is skipped or cut. Null texts and
    ids and passages shorter than a phrase match nothing; an empty list of
    passages gives no rows; repeated documents are each reported.
    """
    listed = passages.select(F.col(eval_id).alias("e"), F.col(passage).alias("p")).filter("e is not null and p is not null").distinct().limit(MOST_PASSAGES + 1).collect()
    if len(listed) > MOST_PASSAGES:
        raise ValueError(f"more than {MOST_PASSAGES} passages")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    table = rewriting(frequencies(docs))
    form = Rewriter(table)
    number: dict[str, int] = {}
    phrases: dict[tuple[int, ...], set[str]] = {}
    for r in sorted(listed, key=lambda r: (r["e"], r["p"])):
        seq = [number.setdefault(w, len(number) + 2) for w, _, _ in words_in(r["p"], form)]
        for i in range(len(seq) - phrase + 1):
            phrases.setdefault(tuple(seq[i : i + phrase]), set()).add(r["e"])
    patterns = np.array(list(phrases), dtype="int64").reshape(-1, phrase)
    owners = [sorted(x) for x in phrases.values()]
    columns = ["doc_id", "eval_id", "first_word", "last_word", "start", "stop"]

    def searched(shard: list[tuple[int, np.ndarray, list[tuple[int, int]]]]) -> pd.DataFrame:
        # 0 ends a text, 1 is any word of no passage.
        seq = np.concatenate([x for _, s, _ in shard for x in (s, [0])])
        begins = np.concatenate([[0], np.cumsum([len(s) + 1 for _, s, _ in shard])])
        index = FMIndex(seq, len(number) + 2)
        lo, hi = index.search(patterns)
        hits = np.flatnonzero(hi > lo)
        counts = (hi - lo)[hits]
        which = np.repeat(hits, counts)
        rows = np.repeat(lo[hits], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        pos = index.locate(rows)
        doc = np.searchsorted(begins, pos, side="right") - 1
        found = sorted({(int(d), e, int(p - begins[d])) for d, p, w in zip(doc, pos, which) for e in owners[w]})
        spans: list[list] = []
        for d, e, p in found:
            if spans and spans[-1][:2] == [d, e] and p <= spans[-1][3] + 1:
                spans[-1][3] = p + phrase - 1
            else:
                spans.append([d, e, p, p + phrase - 1])
        return pd.DataFrame([(shard[d][0], e, a, b, shard[d][2][a][0], shard[d][2][b][1]) for d, e, a, b in spans], columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form, shard, size = Rewriter(table), [], 0
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                ws = words_in(t, form)
                if len(ws) >= phrase:
                    shard.append((i, np.array([number.get(w, 1) for w, _, _ in ws], dtype="int64"), [(x, y) for _, x, y in ws]))
                    size += len(ws) + 1
                    if size >= shard_words:
                        if len(found := searched(shard)):
                            yield found
                        shard, size = [], 0
        if shard and len(found := searched(shard)):
            yield found

    schema = "doc_id long, eval_id string, first_word int, last_word int, start int, stop int"
    if not len(patterns):
        return docs.sparkSession.createDataFrame([], schema)
    return docs.mapInPandas(run, schema)
