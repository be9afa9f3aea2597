"""Licence scans: matching statistics of a generalised suffix automaton of licence words, chained into covered spans.

The automaton holds all templates and is small whatever the input; files are streamed through it once. Each match that can't be longer is
placed at all its places in the templates. A chain is a series of places of one template whose ends rise in the file and in the template,
with at most SKIP words of the file between two; of all chains that end at a place, the one that covers most words is kept. A chain
that covers COVERED of a template, or LONG words that no template of another label holds, gives the template's label; so disclaimers that licences have in
common give none. Phrases that name a licence give base labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM, hash_of, packed, slices, table, word_hashes
from .license_texts import TEMPLATES

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of a match at least; words of the file that a chain may skip; share of a template or own words for a label.
MATCH, SKIP, COVERED, LONG = 3, 16, 0.7, 24


class Automaton:
    """Generalised suffix automaton of sequences of numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, x in enumerate(sequence):
                last = self._extended(last, x, ends)
                ends[last].append((t, i + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                ends[self.link[s]] += ends[s]
        #: all (sequence, end) at which the state's words stand
        self.ends = [sorted(set(e)) for e in ends]

    def _copy(self, p: int, q: int, x: int, ends: list) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        ends.append([])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _extended(self, last: int, x: int, ends: list) -> int:
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, x, ends)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        ends.append([])
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, x, ends)
        return new

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each match that neither side can make longer."""
        state = length = 0
        for i, x in enumerate(words):
            if x not in self.next[state] and length:
                yield i, length, state
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if x in self.next[state]:
                state, length = self.next[state][x], length + 1
            else:
                length = 0
        if length:
            yield len(words), length, state


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        hashes = [hash_of(text, ALNUM) for _, text in templates]
        self.labels, self.sizes = [label for label, _ in templates], [len(h) for h in hashes]
        self.vocabulary = np.unique(np.array([x for h in hashes for x in h], np.uint64))
        self.automaton = Automaton([np.searchsorted(self.vocabulary, np.array(h, np.uint64)).tolist() for h in hashes])
        self.phrases = [(np.array(hash_of(p, ALNUM), np.uint64), label) for p, label in PHRASES.items()]

    def chains(self, h: np.ndarray) -> dict[int, tuple[int, int]]:
        """By template: the most words that one chain covers, and the most that only this label's templates hold."""
        number = np.searchsorted(self.vocabulary, h)
        number[number == len(self.vocabulary)] = 0
        known = self.vocabulary[number] == h if len(self.vocabulary) else np.zeros(len(h), bool)
        edge = np.flatnonzero(np.diff(np.r_[False, known, False]))
        best: dict[int, tuple[int, int]] = {}
        #: by template: chains that a later match may follow, as (end in the file, end in the template, words covered, own words)
        open_: dict[int, list[tuple[int, int, int, int]]] = {}
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s < MATCH:
                continue
            for end, length, state in self.automaton.matches(number[s:e].tolist()):
                if length < MATCH:
                    continue
                end += s
                least = end - length - SKIP
                own = len({self.labels[t] for t, _ in self.automaton.ends[state]}) == 1
                new: dict[int, list[tuple[int, int, int, int]]] = {}
                for t, at in self.automaton.ends[state]:
                    covered, mine = length, length * own
                    for file_end, template_end, words, its_own in open_.get(t, ()):
                        if file_end >= least and template_end < at:
                            more = min(length, at - template_end, end - file_end)
                            covered, mine = max((covered, mine), (words + more, its_own + more * own))
                    new.setdefault(t, []).append((end, at, covered, mine))
                    most, most_own = best.get(t, (0, 0))
                    best[t] = max(most, covered), max(most_own, mine)
                for t, chains in new.items():
                    open_[t] = [c for c in open_.get(t, ()) if c[0] >= least] + chains
        return best

    def scan(self, h: np.ndarray) -> tuple:
        places, base = [], set()
        for phrase, label in self.phrases:
            n = len(h) - len(phrase) + 1
            at = np.flatnonzero(np.logical_and.reduce([h[k : n + k] == x for k, x in enumerate(phrase)])) if n > 0 else np.zeros(0, np.int64)
            if len(at):
                base.add(label)
                places.append(at)
        best = self.chains(h)
        share = {t: min(n / self.sizes[t], 1.0) for t, (n, _) in best.items()}
        labels = base | {self.labels[t] for t, (_, own) in best.items() if share[t] >= COVERED or own >= LONG}
        all_ = np.concatenate(places) if places else np.zeros(0, np.int64)
        first, last = (int(all_.min()), int(all_.max())) if len(all_) else (None, None)
        return len(h), len(all_), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), max(share.values(), default=0.0)


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _scan(templates: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            data, offsets = packed(batch.column(1))
            for i, j in slices(offsets):
                h, _, _, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                found = list(zip(*(scanner.scan(h[p:q]) for p, q in zip(first[:-1], first[1:], strict=True)), strict=True))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], names=NAMES)

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (share of the best covered template).

    Null and empty texts have no words, no labels and a score of 0. Repeated rows give repeated rows. Only doc_id and text are read.
    No shuffle: the automaton of the templates goes to each task.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(_scan(templates), schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}
#: The method's own labels and score are no SQL; the tests compare the base columns with a plain version.
ORACLES: dict[str, str] = {}
