"""License scans by Patience alignment.

A text and a template are cut into lower-case words. Words that occur once in
both are anchors; their longest increasing run of positions splits both sides
into gaps, which are aligned in the same way, equal words at a gap's two ends
first. Coverage is the share of the template's words that are aligned.

A whole text is scanned: stretches start and end at words of a template, found
as its longest chains of rising words in which no two neighbours lie more than
twice the template's length apart, and are aligned then. So neither the place of
a notice nor repeated notices nor words put into it change what is found.
Words that tell a license apart, in braces in its template, must be aligned,
and of templates that align with the same such words the one with the most of
them is reported, of equals the best covered.
Rows stay where they are: no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import TEMPLATES
from .runtime import pick

WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first part, whose second parts rise."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [b], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of two word lists by Patience; rising on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        seen: list[dict[str, int]] = [{}, {}]
        for side, (x, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
            for i in range(lo, hi):
                seen[side][x[i]] = -1 if x[i] in seen[side] else i
        anchors = _rising(sorted((i, seen[1][w]) for w, i in seen[0].items() if i >= 0 and seen[1].get(w, -1) >= 0))
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:]) if r > p + 1 and s > q + 1]
    return sorted(out)


def longest(a: list[str], b: list[str], weight: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of the greatest total weight (of b's words), rising on both sides."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + weight[j] if a[i] == b[j] else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + weight[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, words(text)
        self.need = least * len(self.words)
        self.counts = Counter(self.words)
        self.places = {w: np.array([j for j, x in enumerate(self.words) if x == w]) for w in self.counts}
        parts = re.split(r"[{}]", text)
        ends = np.cumsum([len(words(p)) for p in parts]).tolist()
        self.telling = {j for k in range(1, len(parts), 2) for j in range(ends[k - 1], ends[k])}
        self.must = frozenset(self.words[j] for j in self.telling)
        #: A telling word outweighs all others together.
        self.weight = np.array([1 + (len(self.words) + 1) * (j in self.telling) for j in range(len(self.words))])

    def reaches(self, there: Counter) -> bool:
        """Whether these words are enough for the threshold, in any order."""
        return self.must <= there.keys() and sum(min(k, there[w]) for w, k in self.counts.items()) >= self.need

    def chains(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(words in the chain, first, last) of the best chains that reach the threshold and don't overlap, best first.

        Values are a chain's weight times 2^40 plus its start, so of equally
        good chains the tightest wins. Row p mod `far` of `held` has the best
        values that end at text position p, up to each place in the template.
        """
        n, places = len(self.words), self.places
        far, one = 2 * n, 1 << 40
        here = [i for i, w in enumerate(tokens) if w in places]
        cuts = [0, *(k for k in range(1, len(here)) if here[k] - here[k - 1] > far), len(here)]
        found: dict[int, tuple[int, int]] = {}
        for a, b in zip(cuts, cuts[1:]):
            if b - a < self.need or not self.reaches(Counter(tokens[i] for i in here[a:b])):
                continue
            held, at = np.zeros((far, n + 1), np.int64), here[a] - 1
            for i in here[a:b]:
                for p in range(at + 1, i):
                    held[p % far] = 0
                js, at = places[tokens[i]], i
                before = held.max(0)[js]
                ends = np.where(before > 0, before, i) + one * self.weight[js]
                row = held[i % far]
                row[:] = 0
                row[js + 1] = ends
                np.maximum.accumulate(row, out=row)
                total, start = divmod(int(row[-1]), one)
                told, size = divmod(total, n + 1)
                if told == len(self.telling) and size >= self.need and size > found.get(start, (0, 0))[0]:
                    found[start] = (size, i)
        best: list[tuple[int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for size, start, end in sorted(((size, start, end) for start, (size, end) in found.items()), key=lambda c: (-c[0], c[2] - c[1], c[1])):
            k = bisect_left(taken, (start, -1))
            if (k == len(taken) or taken[k][0] > end) and (k == 0 or taken[k - 1][1] < start):
                taken.insert(k, (start, end))
                best.append((size, start, end))
        return best

    def hits(self, tokens: list[str]):
        """(coverage, first, last, telling words, positions aligned, those of the telling words or, without such, all) of each stretch."""
        for size, a, b in self.chains(tokens):
            part = tokens[a : b + 1]
            pairs = align(part, self.words)
            if len(pairs) < size or not self.telling <= {j for _, j in pairs}:
                pairs = longest(part, self.words, self.weight.tolist())
            yield len(pairs) / len(self.words), a, b, len(self.telling), {a + i for i, _ in pairs}, {a + i for i, j in pairs if j in self.telling or not self.telling}


class Scanner:
    def __init__(self, templates: dict[str, str | tuple[str, ...]], least: float):
        self.templates = [Template(name, t, least) for name, texts in sorted(templates.items()) for t in ([texts] if isinstance(texts, str) else texts) if words(t)]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) of the best stretch of each name that reaches the threshold.

        A hit goes if those of other names with more telling words, or with as
        many and a better coverage, hold half of its telling words or more.
        """
        tokens = words(text)
        there = Counter(tokens)
        hits = [(t.name, *h) for t in self.templates if t.reaches(there) for h in t.hits(tokens)]
        hits.sort(key=lambda h: (-h[1], -len(h[5]), h[3] - h[2], h[2], h[0]))
        claims: dict[int, set[str]] = {}
        found: dict[str, tuple[str, float, int, int]] = {}
        for name, coverage, a, b, _, aligned, own in sorted(hits, key=lambda h: -h[4]):
            if 2 * sum(bool(claims.get(i, set()) - {name}) for i in own) >= len(own):
                continue
            for i in aligned:
                claims.setdefault(i, set()).add(name)
            if name not in found or coverage > found[name][1]:
                found[name] = (name, coverage, a, b)
        return [found[name] for name in sorted(found)]


def scan(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, hits (template, coverage, first_word, last_word) for every row.

    A null or empty text has no hits; each license is reported once, at its
    best stretch, the first of equals. Hits are in order of template names.
    Repeated rows come out each time, a null doc_id stays null, an empty table
    gives an empty result; columns beside doc_id and text are not looked at.
    """
    held = dict(templates or TEMPLATES)

    def run(batches):
        scanner = Scanner(held, least)
        for batch in batches:
            hits = [[dict(zip(("template", "coverage", "first_word", "last_word"), h, strict=True)) for h in scanner.scan(t or "")] for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hits, kind)], ["doc_id", "hits"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, hits array<struct<template: string, coverage: double, first_word: long, last_word: long>>")
