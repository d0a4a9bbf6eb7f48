"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton of all templates is built once; its size follows the templates, not the corpus, and it travels with the
task. A document's words stream through it and give, at each word, the longest stretch of words ending there that
stands in some template (matching statistics). Stretches that cannot be continued and have at least ``LEAST_MATCH``
words are chained per template, in order in both texts with gaps of at most ``MOST_GAP`` words, and a template is found
wherever a chain covers at least ``LEAST_COVER`` of its words, as often as it stands in a text. Words that stand in no template end every stretch, so only
runs of known words are streamed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import frugal
from tallywing.llm.licence_texts import PHRASES, TEMPLATES

LEAST_MATCH, MOST_GAP, LEAST_COVER, FLUSH_ROWS = 3, 6, 0.8, 2000

SCHEMA = ("doc_id long, n_words long, places array<struct<label string, start long>>, "
          "spans array<struct<label string, template int, start long, end long, cover double>>, cover double")

#: Fixed: A-Z become a-z, every other ASCII byte but digits and letters separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """States of all token stretches of several texts; ``ends`` lists (text, end) of a state's stretches."""

    def __init__(self, texts: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        marks: list[list[tuple[int, int]]] = [[]]
        for k, text in enumerate(texts):
            last = 0
            for end, token in enumerate(text):
                last = self._extend(last, token, marks)
                marks[last].append((k, end))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            marks[self.link[state]] += marks[state]
        self.ends = [sorted(set(m)) for m in marks]
        self.ends[0] = []

    def _clone(self, p: int, q: int, token: int, marks: list) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        marks.append([])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int, marks: list) -> int:
        if token in self.next[last]:  # another text has this stretch
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token, marks)
        state, p = len(self.link), last
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        marks.append([])
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token, marks)
        return state

    def stretches(self, tokens: Sequence[int], least: int) -> list[tuple[int, int, int]]:
        """(start, length, state) of the longest stretches of ``tokens`` that cannot be continued, of ``least`` tokens or more."""
        found, state, n = [], 0, 0
        for i, token in enumerate(tokens):
            if token not in self.next[state]:
                if n >= least:
                    found.append((i - n, n, state))
                while state > 0 and token not in self.next[state]:
                    state = self.link[state]
                    n = self.length[state]
                if token not in self.next[state]:
                    n = 0
                    continue
            state, n = self.next[state][token], n + 1
        if n >= least:
            found.append((len(tokens) - n, n, state))
        return found


def apart(span: tuple[int, int], others: list[tuple[int, int]]) -> bool:
    """Whether a span (start, end) meets none of the sorted, separate ``others``."""
    at = bisect_left(others, span)
    return (at == len(others) or others[at][0] >= span[1]) and (at == 0 or others[at - 1][1] <= span[0])


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
                 least_match: int = LEAST_MATCH, most_gap: int = MOST_GAP, least_cover: float = LEAST_COVER):
        texts = [split_words(text) for _, text in templates]
        spoken = [split_words(p) for p, _ in phrases]
        every = sorted({w for t in texts + spoken for w in t})
        self.token = {w: i for i, w in enumerate(every)}
        self.texts = [[self.token[w] for w in t] for t in texts]
        self.labels = [label for label, _ in templates]
        self.phrases = [([self.token[w] for w in p], label) for p, (_, label) in zip(spoken, phrases)]
        self.automaton = SuffixAutomaton(self.texts)
        self.least, self.gap, self.cover = least_match, most_gap, least_cover

    def places(self, ids: np.ndarray) -> list[tuple[str, int]]:
        found = []
        for phrase, label in self.phrases:
            at = np.flatnonzero(ids == phrase[-1]) - (len(phrase) - 1)
            at = at[at >= 0]
            for j, token in enumerate(phrase[:-1]):
                at = at[ids[at + j] == token]
            found += [(label, int(i)) for i in at]
        return sorted(found, key=lambda x: (x[1], x[0]))

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, start, end, cover) of chains of stretches, best first: the best one of each template that has a
        stretch, and every other that covers enough of it and meets none taken before in the text."""
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        hits: dict[int, list[tuple[int, int, int]]] = {}  # template: (start in text, start in template, words)
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < self.least:
                continue
            for start, n, state in self.automaton.stretches(ids[a:b].tolist(), self.least):
                for k, end in self.automaton.ends[state]:
                    hits.setdefault(k, []).append((a + start, end - n + 1, n))
        found = []
        for k, left in hits.items():
            size, more = len(self.texts[k]), False
            while left:
                best = self.chains(left, size)
                taken: list[tuple[int, int]] = []
                for i in sorted(range(len(left)), key=lambda i: (-best[i][0], i)):
                    words, start = best[i]
                    span = start, left[i][0] + left[i][2]
                    if more and words < self.cover * size:
                        break
                    if apart(span, taken):
                        insort(taken, span)
                        found.append((k, *span, min(1.0, words / size)))
                        more = True
                left = [s for s in left if apart((s[0], s[0] + s[2]), taken)] if taken else []
        return sorted(found, key=lambda f: (-f[3], f[0], f[1]))

    def chains(self, stretches: list[tuple[int, int, int]], size: int) -> list[tuple[int, int]]:
        """For each stretch (start in text, start in template, words): the words that the best chain ending there covers, and its start."""
        best: list[tuple[int, int]] = []
        for i, (x, t, n) in enumerate(stretches):
            most = (n, x)
            for j in range(i - 1, -1, -1):
                px, pt, pn = stretches[j]
                if x - px > size + self.gap + n:
                    break
                over = max(0, px + pn - x, pt + pn - t)
                if px < x and pt < t and over < n and x - (px + pn) <= self.gap and t - (pt + pn) <= self.gap:
                    most = max(most, (best[j][0] + n - over, best[j][1]), key=lambda m: (m[0], -m[1]))
            best.append(most)
        return best

    def read(self, text: str | None) -> tuple:
        words = split_words(text)
        if not words:
            return 0, [], [], 0.0
        get = self.token.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        if not (ids >= 0).any():
            return len(words), [], [], 0.0
        spans = self.spans(ids)
        return (len(words), self.places(ids),
                [(self.labels[k], k, a, b, c) for k, a, b, c in spans if c >= self.cover], spans[0][3] if spans else 0.0)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, n_words, places, spans, cover) of every row of ``docs``.

    ``places`` are where the phrases stand (label, first word), ``spans`` the covered template spans, each of them where a
    text holds a notice several times (label, template, start, end, cover) and ``cover`` the largest share of a template
    that any chain covers, found or not. A NULL or empty text has no words, places or spans and cover 0. Repeated rows are
    scanned alike; an empty table gives no rows.
    """
    scanner = scanner or Scanner()
    place = pa.struct([("label", pa.string()), ("start", pa.int64())])
    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.list_(place), pa.list_(span), pa.float64()]
    names = ["doc_id", "n_words", "places", "spans", "cover"]

    def rows(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, FLUSH_ROWS):
                part = batch.slice(a, FLUSH_ROWS)
                out = [scanner.read(part.column(1)[i].as_py()) for i in range(part.num_rows)]
                columns = [part.column(0)] + [pa.array(list(c), t) for c, t in zip(([r[0] for r in out], [
                    [{"label": x, "start": s} for x, s in r[1]] for r in out], [
                    [dict(zip(("label", "template", "start", "end", "cover"), s)) for s in r[2]] for r in out],
                    [r[3] for r in out]), types[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(rows), SCHEMA)


def labelled(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) from ``scan``."""

    def joined(names):
        return F.array_join(F.array_sort(F.array_distinct(names)), ",")

    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"])
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"), F.col("cover").alias("score"))
