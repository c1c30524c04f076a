r"""License scans by template-markup matching.

A template is wording with marked regions: ``[words]`` is optional, ``<a-b>`` is replaceable by a to b words of
any kind, everything else is mandatory and must match word for word. Templates are compiled to token automata,
which run over the words of a text from each place where the first mandatory word stands. A text is accepted if
an automaton reaches its end.

Words: A-Z lower-cased, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernels import C1, Words, slices

#: Phrases whose every place counts, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

TEMPLATES = [
    ("mit", "[the] <0-8> [is] released under the [terms of the] mit license"),
    ("mit", "[is] licensed under the [terms of the] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this <1-3> and associated documentation files the <1-3> to deal in the <1-3> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the <1-3> and to permit persons to whom the <1-3> is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the <1-3>"),
    ("mit", "the <1-3> is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <0-3> authors or copyright <1-3> be liable for any claim damages or other liability"),
    ("apache-2", "licensed under the apache license version 2 [0]"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <0-10> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3", "<0-3> licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3"),
    ("gpl-3", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2"),
    ("gpl-2", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "licensed under the [terms of the] gnu lesser general public license"),
    ("lgpl", "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "licensed under the [terms of the] gnu affero general public license [version 3]"),
    ("agpl-3", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("cc-by-nc", "licensed under [a] [the] [creative commons] cc by nc [sa] [nd] [4] [3] [0] [license]"),
    ("cc-by-nc", "licensed under [a] [the] creative commons attribution noncommercial"),
    ("cc-by", "licensed under [a] [the] creative commons attribution <0-1> international"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "[copyright] <0-8> all rights reserved"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-3", "spdx license identifier gpl 3 0 [only] [or later]"),
    ("bsd", "spdx license identifier bsd <1-1> clause"),
]

class Automaton:
    """Compiled template. States are places in its list of steps: a word, an optional run, or a gap."""

    def __init__(self, label: str, markup: str) -> None:
        self.label = label
        steps: list[tuple] = []
        for opt, lo, hi, word in re.findall(r"\[([^\]]+)\]|<(\d+)-(\d+)>|(\S+)", markup):
            steps.append(("optional", tuple(opt.split())) if opt else ("gap", int(lo), int(hi)) if hi else ("word", word))
        # Regions before the first mandatory word cannot decide anything.
        while steps[0][0] != "word":
            steps.pop(0)
        self.steps = steps
        self.first = steps[0][1]
        self.mandatory = sum(s[0] == "word" for s in steps)

    def begins(self) -> set[tuple[str, str | None]]:
        """The first mandatory word with each word that may follow where more than it matches; None if any word may."""
        out = set()
        for step in self.steps[1:]:
            if step[0] == "gap":
                return out | {(self.first, None)}
            out.add((self.first, step[1] if step[0] == "word" else step[1][0]))
            if step[0] == "word":
                return out
        return out | {(self.first, None)}

    def run(self, words: list[str], start: int) -> tuple[bool, int]:
        """Whether the template matches from ``start``, and how many mandatory words matched at most."""
        states, best, seen = [(0, start, 0)], 0, set()
        while states:
            step, at, n = states.pop()
            best = max(best, n)
            if step == len(self.steps):
                return True, n
            if (step, at) in seen:
                continue
            seen.add((step, at))
            kind, *rest = self.steps[step]
            if kind == "word":
                if at < len(words) and words[at] == rest[0]:
                    states.append((step + 1, at + 1, n + 1))
            elif kind == "optional":
                states.append((step + 1, at, n))
                if tuple(words[at : at + len(rest[0])]) == rest[0]:
                    states.append((step + 1, at + len(rest[0]), n))
            else:
                states.extend((step + 1, at + g, n) for g in range(rest[1], rest[0] - 1, -1) if at + g <= len(words))
        return False, best


def scan_words(words: list[str], automata: list[Automaton]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """Places of phrases, the first and last of them, their labels, the labels of accepted templates, and the score."""
    places, labels, accepted, score = [], set(), set(), 0.0
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        found = [i for i in at.get(parts[0], ()) if words[i : i + len(parts)] == parts]
        places += found
        if found:
            labels.add(label)
    for a in automata:
        for i in at.get(a.first, ()):
            whole, n = a.run(words, i)
            if whole:
                accepted.add(a.label)
            if whole or n > 1:
                score = max(score, 1.0 if whole else n / a.mandatory)
    return len(places), min(places, default=None), max(places, default=None), labels, accepted, score


def _hash(words: list[str]) -> np.ndarray:
    return Words(pa.array(words), alnum=True).hashes()


class _Begins:
    """Finds the rows in which some phrase or template may match in more than its first word: by hashes of words and of pairs of words."""

    def __init__(self, automata: list[Automaton]) -> None:
        pairs = set().union(*(a.begins() for a in automata)) | {((p := phrase.split())[0], p[1] if len(p) > 1 else None) for phrase in PHRASES}
        self.alone = np.unique(_hash(sorted({a for a, b in pairs if b is None})))
        both = sorted((a, b) for a, b in pairs if b is not None)
        self.pairs = np.unique(_hash([a for a, _ in both]) * C1 + _hash([b for _, b in both])) if both else np.zeros(0, np.uint64)

    def rows(self, words: Words) -> list[int]:
        h = words.hashes()
        found = np.isin(h, self.alone) if len(self.alone) else np.zeros(len(h), bool)
        if len(h) > 1 and len(self.pairs):
            found[:-1] |= np.isin(h[:-1] * C1 + h[1:], self.pairs)
        return np.unique(words.row[found]).tolist()


def _scan(templates: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(*t) for t in templates]
        begins = _Begins(automata)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                words = Words(batch.column("text").slice(a, b - a), alnum=True)
                data = words.data.tobytes()
                rows = [(0, None, None, "", "", 0.0)] * (b - a)
                for i in begins.rows(words):
                    first, n = int(words.first[i]), int(words.counts[i])
                    spans = zip(words.start[first : first + n].tolist(), words.end[first : first + n].tolist(), strict=True)
                    places, lo, hi, base, accepted, score = scan_words([data[s:e].decode() for s, e in spans], automata)
                    rows[i] = (places, lo, hi, ",".join(sorted(base)), ",".join(sorted(base | accepted)), 1.0 if base else score)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                head = [batch.column("doc_id").slice(a, b - a), pa.array(words.counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def license_scan(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``n_base`` counts all places of the phrases; ``labels`` adds those of accepted templates; ``score`` is 1 if a
    phrase or a template matched whole, else the largest share of a template's mandatory words that did, from its
    first word on and more than that one. Null text is empty. Null ids and repeated rows are scanned row by row; extra columns are
    ignored; no rows give no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return given.mapInArrow(_scan(templates or TEMPLATES), out)
