"""License scans by template-markup matching.

A template is the wording of a license in words (lower case, no punctuation), with markup for
what may differ between copies:

* ``<<opt>> ... <</opt>>``: the words inside may be missing (regions nest);
* ``<<var 0 12>>``: any words, between 0 and 12 of them;
* ``<<one of copyright copyrights>>``: one of the listed words.

Each template is compiled to an automaton over words: states, an arc for every mandatory word,
counted arcs for replaceable words, empty arcs around optional regions. A text is accepted from a
word on if all mandatory wording is there, word for word, in order. Texts are whole and stay in
their task; the automata are a constant of the template list. Sets of states are worked out once
and kept (a lazily built deterministic automaton), so most words of a text cost one lookup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Separators of words, base phrases, wording of well-known licenses and notices.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TEMPLATES = {
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be
        included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        <<var 1 12>> be liable for any claim damages or other liability whether in an action of contract tort or
        otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "isc-text": """permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or
        without fee is hereby granted provided that the above copyright notice and this permission notice appear in all
        copies the software is provided as is and <<var 1 12>> <<one of disclaims disclaim>> all warranties with regard to this
        software""",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided
        that the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in
        binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in
        the documentation and or other materials provided with the distribution""",
    "apache-2-notice": """licensed under the apache license version 2 <<opt>>0<</opt>> the license you may not use this
        file except in compliance with the license""",
    "apache": "licensed under the apache <<opt>>software<</opt>> license",
    "mit-notice": "<<one of licensed released distributed available>> under the <<opt>>terms of the<</opt>> mit license",
    "gpl": """gnu <<opt>><<one of lesser library affero>><</opt>> general public license <<opt>>as published by the free
        software foundation either<</opt>> version <<one of 1 2 3>>""",
    "cc-short": "cc by <<opt>>nc<</opt>> <<opt>><<one of sa nd>><</opt>> <<one of 1 2 3 4>> <<one of 0 5>>",
    "cc-long": """creative commons attribution <<opt>>noncommercial<</opt>>
        <<opt>><<one of sharealike noderivatives noderivs>><</opt>> <<one of 1 2 3 4>> <<one of 0 5>>""",
    "mpl": "mozilla public license <<opt>>version<</opt>> <<opt>>v<</opt>> <<one of 1 2>>",
    "public-domain": "released into the public domain",
    "reserved": "all rights reserved",
    "spdx": "spdx license identifier <<var 1 1>>",
}
# How much wording outweighs a chance meeting: evidence is words / (words + this).
DOUBT = 4

_MARK = re.compile(r"<<(/?[a-z]+)((?: [a-z0-9]+)*)>>|([^<\s]+)")
_ANY = None


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, everything but letters, digits and non-ASCII separates."""
    return text.translate(_FOLD).split(b" ")


_FOLD = bytearray(range(256))
for _b in SEPARATORS:
    _FOLD[_b] = 0x20
for _b in range(0x41, 0x5B):
    _FOLD[_b] = _b + 0x20
_FOLD = bytes(_FOLD)


@dataclass
class Automaton:
    """One compiled template. ``arcs[state]`` are (word or _ANY, next state), ``empty[state]`` the
    states reached without a word; the last state accepts."""

    label: str
    mandatory: int = 0
    arcs: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    empty: list[list[int]] = field(default_factory=lambda: [[]])

    def _state(self) -> int:
        self.arcs.append([])
        self.empty.append([])
        return len(self.arcs) - 1

    def _read(self, at: int, words: list[bytes | None]) -> int:
        """A new state behind ``at``, reached by any of the words."""
        to = self._state()
        self.arcs[at] += [(w, to) for w in words]
        return to

    def reached(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    @cached_property
    def start(self) -> frozenset[int]:
        return self.reached({0})

    @cached_property
    def first_words(self) -> frozenset[bytes]:
        return frozenset(w for s in self.start for w, _ in self.arcs[s])

    @cached_property
    def _steps(self) -> dict[tuple[frozenset[int], bytes], frozenset[int]]:
        return {}

    @cached_property
    def _known(self) -> frozenset[bytes]:
        return frozenset(w for arcs in self.arcs for w, _ in arcs if w is not _ANY)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        # Words no arc names behave alike, so the table of steps stays small.
        key = (states, word if word in self._known else b"")
        found = self._steps.get(key)
        if found is None:
            found = self.reached({to for s in states for w, to in self.arcs[s] if w is _ANY or w == key[1]})
            self._steps[key] = found
        return found

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words that starts at ``at``, or -1."""
        states, end, last = self.start, -1, len(self.arcs) - 1
        for i in range(at, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            if last in states:
                end = i + 1
        return end


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template. It has to begin and end with words of its own: a leading or
    trailing replaceable region would accept anything."""
    out, at, opened = Automaton(label), 0, []
    for mark in _MARK.finditer(template):
        name, rest, word = mark[1], (mark[2] or "").split(), mark[3]
        if word is not None:
            at = out._read(at, [word.encode()])
            out.mandatory += not opened
        elif name == "opt":
            opened.append(at)
        elif name == "/opt":
            if not opened:
                raise ValueError(f"{label}: region closed that was not opened")
            out.empty[opened.pop()].append(at)
        elif name == "one" and rest[:1] == ["of"] and len(rest) > 1:
            at = out._read(at, [w.encode() for w in rest[1:]])
            out.mandatory += not opened
        elif name == "var" and len(rest) == 2 and 0 <= int(rest[0]) <= int(rest[1]):
            low, high = map(int, rest)
            ways = [at]
            for _ in range(high):
                ways.append(out._read(ways[-1], [_ANY]))
            for early in ways[low:-1]:
                out.empty[early].append(ways[-1])
            at = ways[-1]
        else:
            raise ValueError(f"{label}: unknown markup {mark[0]}")
    if opened:
        raise ValueError(f"{label}: region not closed")
    if not out.mandatory or _ANY in out.first_words or len(out.arcs) - 1 in out.start:
        raise ValueError(f"{label}: needs mandatory wording, first of all")
    if at != len(out.arcs) - 1:
        raise ValueError(f"{label}: does not end with its last state")
    return out


def compile_all(templates: dict[str, str]) -> list[Automaton]:
    return [compile_template(label, t) for label, t in templates.items()]


def spans(words: list[bytes], automata: list[Automaton], starts: dict[bytes, list[int]]) -> list[tuple[int, int, int]]:
    """(automaton, first word, end) of every accepted place, the longest run from each start."""
    found = []
    for i, w in enumerate(words):
        if w in starts:
            for k in starts[w]:
                end = automata[k].longest(words, i)
                if end > 0:
                    found.append((k, i, end))
    return found


SPAN = "array<struct<label: string, first: long, end: long>>"


def license_spans(
    docs: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, n_words, and spans (label, first word, end) in order of place.

    Null and empty texts have no words and no spans. Repeated rows and ids, null ids included,
    each give a row. A text may be as long as a task can hold; it is read whole. An empty table
    gives no rows; other columns are not read, whatever their names."""
    id_type = docs.schema[id_col].dataType
    id_name = id_type.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compile_all(templates)
        starts: dict[bytes, list[int]] = {}
        for k, a in enumerate(automata):
            for w in a.first_words:
                starts.setdefault(w, []).append(k)
        known = frozenset(starts)
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            counts, places = [], []
            for value in batch.column("t"):
                raw = value.as_buffer()
                words = [w for w in words_of(raw.to_pybytes() if raw is not None else b"") if w]
                counts.append(len(words))
                hits = [] if known.isdisjoint(words) else spans(words, automata, starts)
                places.append([{"label": automata[k].label, "first": i, "end": e} for k, i, e in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(places, kind)], names=["id", "n_words", "spans"]
            )

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return text.mapInArrow(scan, f"id {id_name}, n_words long, spans {SPAN}").withColumnRenamed("id", id_col)


def license_report(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Digest of the spans of the base phrases and of ``templates`` (default: TEMPLATES).

    doc_id, n_words, n_base (places of base phrases), first_word and last_word (smallest and largest
    start of these, null without any), base_labels and labels (distinct, sorted, comma-joined), score:
    the strongest evidence among the labels, m / (m + 4) for m mandatory words; 0 without a label.
    Nulls, empty texts, repeated rows and empty tables: see ``license_spans``."""
    own = TEMPLATES if templates is None else templates
    if set(own) & set(BASE):
        raise ValueError("a template may not take the label of a base phrase")
    every = BASE | own
    evidence = {a.label: a.mandatory / (a.mandatory + DOUBT) for a in compile_all(every)}
    weights = F.create_map(*[F.lit(v) for pair in evidence.items() for v in pair])
    places = license_spans(docs, every)
    base = F.filter("spans", lambda s: s["label"].isin(*BASE))
    labels = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["label"])))
    return places.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        F.array_join(F.filter(labels, lambda n: n.isin(*BASE)), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(labels, lambda n: weights[n])), F.lit(0.0)).alias("score"),
    )
