"""Evaluation texts inside a training corpus, by q-gram filtering and banded alignment.

Texts are brought to words joined by single blanks. Every document position whose character q-gram occurs in an item is a hit on a
diagonal (document position - item position). By the q-gram lemma a passage of length L with at most e edits shares at least
L + 1 - q (e + 1) grams with its source, all within a narrow band of diagonals. Windows begin at every hit, so each passage of at least
WINDOW characters with no more than EDITS edits in any window is kept, wherever it lies; windows that meet the bound are joined to
regions, which banded alignment verifies, as wholes or else window by window. With no edits allowed the same bound keeps every run of
`run_words` equal words: with the blanks around it, such a run is longer than q. Only inside verified regions are words then compared.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 16  # characters of a gram, a power of two; a run of 8 words and the blanks around it has 17 at least
BAND = 16  # width of a band of diagonals; bands overlap by half
WINDOW = 100  # characters of a window in which hits are counted; one begins at every hit
EDITS = 2  # edits allowed in a window
BLOCK_CHARS = 4_000_000  # characters of items that one index holds; more items are searched in several passes over the corpus
CHUNK = 1_000_000  # characters of documents that are hashed at a time
BASE = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"[^\W_]+")
_INDEXES: dict = {}


@lru_cache(1)
def format_characters() -> tuple[frozenset[str], dict[int, None]]:
    """All characters of category Cf, and a table that deletes them."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"]
    return frozenset(map(chr, found)), dict.fromkeys(found)


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC, removal of format characters and lower-casing."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        some, delete = format_characters()
        if not some.isdisjoint(text):
            text = text.translate(delete)
    return _WORD.findall(text.lower())


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters from each position on, by doubling."""
    h, size, factor = codes.astype(np.uint64) + np.uint64(1), 1, BASE
    with np.errstate(over="ignore"):
        while size < q:
            h = h[: len(h) - size] * factor + h[size:]
            factor = factor * factor
            size *= 2
        return h ^ (h >> np.uint64(29))


class Index:
    """Grams, postings and word runs of a block of items."""

    def __init__(self, items: list[tuple[int, str]], run_words: int):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words = [words(t) for _, t in items]
        texts = [" " + " ".join(w) + " " if w else "" for w in self.words]
        self.codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        hashed = [grams(c) if len(c) >= Q else np.empty(0, np.uint64) for c in self.codes]
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashed])
        place = np.concatenate([np.arange(len(h)) for h in hashed] or [np.empty(0, int)])
        all_grams = np.concatenate(hashed or [np.empty(0, np.uint64)])
        order = np.argsort(all_grams, kind="stable")
        self.grams, self.first = np.unique(all_grams[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.item, self.place = item[order], place[order]
        self.bits = 24
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.grams >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.runs: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for i, w in enumerate(self.words):
            for j in range(len(w) - run_words + 1):
                self.runs.setdefault(tuple(w[j : j + run_words]), []).append((i, j))

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose gram some item has, and the gram's number."""
        if len(codes) < Q or not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = grams(codes)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        true = self.grams[found] == h[at]
        return at[true], found[true]


def banded_distances(a: list[np.ndarray], b: list[np.ndarray], band: int, together: int = 256) -> np.ndarray:
    """Edit distance of each pair of sequences over alignments whose diagonals stay within `band` of the corner's, all pairs side by side.

    A pair that no such alignment joins gets the sum of its lengths.
    """
    out = np.zeros(len(a), np.int64)
    order = np.argsort([len(x) for x in a], kind="stable")
    offsets = np.arange(-band, band + 1, dtype=np.int32)
    for c in range(0, len(order), together):
        some = order[c : c + together]
        n, m = np.array([len(a[i]) for i in some], np.int32), np.array([len(b[i]) for i in some], np.int32)
        far = int((n + m).max()) + 1
        left, right = np.zeros((len(some), n.max() + 1), np.int64), np.full((len(some), n.max() + 2 * band + 2), -1, np.int64)
        for r, i in enumerate(some):  # column k of `right` holds b[k - band - 1], so row i sees b[i - 1 + offset] in one slice
            left[r, 1 : n[r] + 1] = a[i]
            upto = min(m[r], right.shape[1] - band - 1)
            right[r, band + 1 : band + 1 + upto] = b[i][:upto]
        row = np.where((offsets >= 0) & (offsets <= m[:, None]), offsets, far).astype(np.int32)
        last = row.copy()
        for i in range(1, int(n.max()) + 1):
            j = offsets + i
            cost = right[:, i : i + 2 * band + 1] != left[:, i : i + 1]
            step = row + cost
            np.minimum(step[:, :-1], row[:, 1:] + 1, out=step[:, :-1])
            step[:, j < 0] = far
            step[:, j == 0] = i
            row = np.minimum.accumulate(step - offsets, axis=1) + offsets  # insertions along the row
            done = n == i
            if done.any():
                last[done] = row[done]
        shift = m - n
        near = np.abs(shift) <= band
        out[some] = np.where(near, np.minimum(last[np.arange(len(some)), np.where(near, shift + band, 0)], n + m), n + m)
    return out


def starts_of(*keys: np.ndarray) -> np.ndarray:
    change = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.flatnonzero(np.r_[True, change]) if len(keys[0]) else np.empty(0, np.int64)


def windows(at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted hit positions: index behind the last hit of the window that begins at each hit, which windows have enough hits, and which
    hits lie in one of these."""
    ends = np.searchsorted(at, at + (WINDOW - Q), "right")
    fine = ends - np.arange(len(at)) >= least
    edge = fine.astype(np.int64) - np.bincount(ends[fine], minlength=len(at) + 1)[: len(at)]
    return ends, fine, np.cumsum(edge) > 0


def regions(index: Index, codes: np.ndarray, starts: np.ndarray, run_words: int) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """Retained and verified regions (document from, to, item from, to) by (document, item); `starts` are the documents' first positions in codes."""
    at, gram = index.hits(codes)
    if not len(at):
        return {}
    blanks = np.r_[0, np.cumsum(codes == 32)]
    doc = np.searchsorted(starts, at, "right") - 1
    # hits that can be in a retained region of any item: those in a long run of hits, or in a window with enough of them
    least = WINDOW + 1 - Q * (EDITS + 1)
    first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    last = np.r_[first[1:], len(at)] - 1
    long = blanks[at[last] + Q] - blanks[at[first]] > run_words
    use = np.repeat(long, last - first + 1) | windows(at, least)[2]
    at, gram, doc = at[use], gram[use], doc[use]
    if not len(at):
        return {}
    times = index.first[gram + 1] - index.first[gram]
    post = np.repeat(index.first[gram], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    p, item, s = np.repeat(at, times), index.item[post], index.place[post]
    pair = np.repeat(doc, times) * len(index.ids) + item
    diagonal = p - s
    order = np.lexsort((diagonal, pair))  # stable, and positions ascend already
    p, s, pair, diagonal = p[order], s[order], pair[order], diagonal[order]
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    # no edits: runs of hits on one diagonal that hold run_words whole words; the alignment is the comparison of both sides
    first = starts_of(pair, diagonal, p - np.arange(len(p)))
    last = np.r_[first[1:], len(p)] - 1
    for a, b in zip(first[(some := blanks[p[last] + Q] - blanks[p[first]] > run_words)].tolist(), last[some].tolist()):
        x, y, u, v = int(p[a]), int(p[b]) + Q, int(s[a]), int(s[b]) + Q
        if (codes[x:y] == index.codes[pair[a] % len(index.ids)][u:v]).all():
            found.setdefault(int(pair[a]), []).append((x, y, u, v))
    # some edits: windows of overlapping bands
    first = starts_of(pair)
    size = np.diff(np.r_[first, len(pair)])
    many = np.repeat(size >= least, size)  # pairs with fewer hits have no window with enough
    p, s, pair, diagonal = p[many], s[many], pair[many], diagonal[many]
    retained: dict[int, dict[tuple[int, int, int, int], list[tuple[int, int, int, int]]]] = {}
    for shift in (0, BAND // 2):
        band = (diagonal + shift + (1 << 40)) // BAND
        order = np.lexsort((p, band, pair))
        x, y, g = p[order], s[order], np.zeros(len(order), np.int64)
        g[starts_of(pair[order], band[order])] = 1
        g = np.cumsum(g)
        ends, fine, inside = windows(g * (len(codes) + 2 * WINDOW) + x, least)
        for a, b in runs_of_true(inside, g):
            extent = lambda i, j: (int(x[i:j].min()), int(x[i:j].max()) + Q, int(y[i:j].min()), int(y[i:j].max()) + Q)
            parts, i = [], a
            while i < b:
                if fine[i]:
                    parts.append(extent(i, ends[i]))
                i = max(i + 1, int(ends[i])) if fine[i] else i + 1
            retained.setdefault(int(pair[order[a]]), {})[extent(a, b)] = parts
    tried = []
    for key, spans in retained.items():
        known = list(found.get(key, []))
        for span in sorted(spans, key=lambda r: r[0] - r[1]):  # the longest first; what lies inside another adds nothing
            if not any(x <= span[0] and y >= span[1] and u <= span[2] and v >= span[3] for x, y, u, v in known):
                known.append(span)
                tried.append((key, span, spans[span]))
    while tried:
        edits = banded_distances([index.codes[key % len(index.ids)][u:v] for key, (_, _, u, v), _ in tried], [codes[x:y] for _, (x, y, _, _), _ in tried], BAND)
        smaller = []
        for (key, span, parts), e in zip(tried, edits.tolist()):
            if e <= EDITS * -(-(span[1] - span[0]) // WINDOW):
                found.setdefault(key, []).append(span)
            else:  # the region holds more edits than its length allows: its windows are verified singly
                smaller += [(key, part, []) for part in parts if part != span]
        tried = smaller
    return {(key // len(index.ids), key % len(index.ids)): spans for key, spans in found.items()}


def runs_of_true(mask: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """From and to of each run of true values within one group."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(group[at]) != 0))
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + 1).tolist()))


def words_in_runs(index: Index, item: int, own: list[str], begins: np.ndarray, spans: list[tuple[int, int]], run_words: int) -> float:
    """Share of the item's words that lie in runs of run_words equal words of the document's spans (from, to, in its characters).

    own: the document's words, begins: where each begins.
    """
    pieces = set()
    for x, y in spans:
        a, b = begins.searchsorted([x, y]).tolist()
        if b > a and begins[b - 1] + len(own[b - 1]) > y:
            b -= 1
        for j in range(a, b - run_words + 1):
            pieces.update(place for i, place in index.runs.get(tuple(own[j : j + run_words]), ()) if i == item)
    return share([(j, j + run_words) for j in pieces], len(index.words[item]))


def share(pieces: list[tuple[int, int]], n: int) -> float:
    """Share of n positions that the pieces cover."""
    covered = np.zeros(n, bool)
    for a, b in pieces:
        covered[a:b] = True
    return float(covered.mean()) if n else 0.0


def leaks(documents: DataFrame, id_column: str, text_column: str, items: DataFrame, item_column: str = "item_id", item_text: str = "text", run_words: int = 8) -> DataFrame:
    """(doc_id, item_id, word_share, char_share) for every document and item with a verified region.

    char_share: share of the item's characters in verified regions, which may hold a few edits. word_share: share of the item's words in
    runs of at least `run_words` consecutive words that a verified region of the document has too, anywhere and in any order, exactly
    counted (every such run lies in a verified region); an item of fewer words has none. Null and empty texts leak nothing. A repeated
    document id is judged as one text per row, one row per text and item. Item ids are unique; items are searched in blocks of bounded
    size, each in one pass over the documents, which are not shuffled.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text")).where("text is not null")
    wanted = items.select(F.col(f"`{item_column}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text")).where("item is not null and text is not null")
    blocks, block, held = [], [], 0
    for r in wanted.orderBy("item").toLocalIterator():
        if held + len(r["text"]) > BLOCK_CHARS and block:
            blocks.append(block)
            block, held = [], 0
        block.append((r["item"], r["text"]))
        held += len(r["text"])
    blocks.append(block)
    schema = "doc_id long, item_id long, word_share double, char_share double"
    out = None
    for block in blocks:
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _INDEXES:  # built once in each worker
                _INDEXES.clear()
                _INDEXES[name] = Index(sent.value, run_words)
            index = _INDEXES[name]
            for batch in batches:
                ids, raw = batch.column("id").to_pylist(), batch.column("text").to_pylist()
                at = 0
                while at < len(ids):
                    pieces, lists, size, begin = [], [], 0, at
                    while at < len(ids) and (size < CHUNK or at == begin):
                        w = words(raw[at])
                        lists.append(w)
                        pieces.append(" " + " ".join(w) + " \0")
                        size += len(pieces[-1])
                        at += 1
                    starts = np.cumsum([0, *map(len, pieces)])[:-1]
                    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
                    found = regions(index, codes, starts, run_words)
                    rows, at_doc, begins = [], -1, None
                    for (d, i), spans in sorted(found.items()):
                        if d != at_doc:
                            at_doc, begins = d, 1 + np.cumsum([0, *(len(w) + 1 for w in lists[d])])[:-1]
                        inside = [(x - starts[d], y - starts[d]) for x, y, _, _ in spans]
                        rows.append((ids[begin + d], int(index.ids[i]), words_in_runs(index, i, lists[d], begins, inside, run_words), share([(u, v) for _, _, u, v in spans], len(index.codes[i]))))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["doc_id", "item_id", "word_share", "char_share"])

        part = texts.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out
