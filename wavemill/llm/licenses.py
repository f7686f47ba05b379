"""Licence scans by template markup compiled to token automata.

A template is licence wording with markup: ``[...]`` is an optional region, which may nest,
and ``<name:n>`` a replaceable one of up to n words of any kind. It compiles to an
automaton over words: a step per mandatory word, an empty step past each optional
region, and up to n any-word steps for a replaceable one. A text is accepted where all
mandatory wording stands word for word in order with nothing between but what the
markup allows. Words are letters, digits and non-ASCII characters, A-Z lower-cased, so punctuation,
case and layout never matter. Automata only start at places of their first mandatory word, which are
found for a whole batch at once by word hash.

Beside the templates, plain phrases are looked up at every place.

Words are compared by a 64-bit hash of their bytes, not byte by byte: with some hundred words in all phrases and templates, a word
of a text is taken for one of them by mistake about once in 10^17 words.

One Arrow pass over whole texts, no shuffle; the automata are a few kB.

Defined cases: null and empty texts have no words and no labels; matches may overlap and
all count; a match may not cross texts; templates that accept an empty text are refused; other columns pass
through ``scan`` untouched, but n_words and matches are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.llm import textnp
from wavemill.llm.common import small_batches, without

#: Fixed by the contract: phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and template.
TEMPLATES = {
    "mit-notice": "under the [terms of the] mit license",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this <work:3> "
        "[and associated documentation files] [the <name:2>] to deal in the <work:3> without restriction"
    ),
    "apache-2.0": "licensed under the apache license [<name:3>] version 2 0",
    "gpl-3.0": "under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3",
    "cc-by-nc-4.0": "under [a] [the] cc by nc 4 0",
    "bsd-conditions": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met"
    ),
}


def parse(template: str) -> list:
    """The markup as a tree: words as strings, replaceable regions as their length, optional regions as lists."""
    stack: list[list] = [[]]
    for part in re.findall(r"\[|\]|<[^<>]*>|[^\s\[\]<>]+", template):
        if part == "[":
            stack.append([])
        elif part == "]":
            if len(stack) == 1:
                raise ValueError(f"']' without '[' in {template!r}")
            done = stack.pop()
            stack[-1].append(done)
        elif part[0] == "<":
            stack[-1].append(int(part[1:-1].rpartition(":")[2]))
        else:
            stack[-1].append(part)
    if len(stack) > 1:
        raise ValueError(f"'[' without ']' in {template!r}")
    tree = stack[0]
    # A search accepts around what may be missing at either end.
    while tree and not isinstance(tree[0], str):
        tree = tree[1:]
    while tree and not isinstance(tree[-1], str):
        tree = tree[:-1]
    if not tree:
        raise ValueError(f"no mandatory wording in {template!r}")
    return tree


@dataclass
class Automaton:
    """States 0..n; ``word`` and ``wild`` steps go to the next state, ``skip`` steps to any and read nothing."""

    word: dict[int, int] = field(default_factory=dict)
    wild: set[int] = field(default_factory=set)
    skip: dict[int, list[int]] = field(default_factory=dict)
    end: int = 0

    def add(self, tree: list) -> None:
        for part in tree:
            begin = self.end
            if isinstance(part, str):
                self.word[begin] = word_hash(part)
                self.end += 1
            elif isinstance(part, int):
                for k in range(part):
                    self.wild.add(begin + k)
                self.end += part
                for k in range(part):
                    self.skip.setdefault(begin + k, []).append(self.end)
            else:
                self.add(part)
                self.skip.setdefault(begin, []).append(self.end)

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip.get(todo.pop(), ()):
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[int]) -> int:
        """How many words the shortest match at the beginning takes; 0 if none does."""
        states = self.closure({0})
        for n, w in enumerate(words, 1):
            states = self.closure({s + 1 for s in states if s in self.wild or self.word.get(s) == w})
            if self.end in states:
                return n
            if not states:
                return 0
        return 0


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(textnp.span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def compiled(template: str) -> Automaton:
    automaton = Automaton()
    automaton.add(parse(template))
    return automaton


def _found(hashes: np.ndarray, first: np.ndarray, phrases, automata) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Texts, starts and ends (in words of the text) of all matches, by the number of the phrase or template."""
    end_of = lambda at: first[np.searchsorted(first, at, side="right")]
    for nr, words in enumerate(phrases):
        n = max(0, len(hashes) - len(words) + 1)
        hit = np.ones(n, bool)
        for k, w in enumerate(words):
            hit &= hashes[k : k + n] == w
        at = np.flatnonzero(hit)
        if len(at):
            at = at[at + len(words) <= end_of(at)]
        yield at, at + len(words), nr
    for nr, automaton in enumerate(automata, len(phrases)):
        at = np.flatnonzero(hashes == np.uint64(automaton.word[0]))
        ends = end_of(at) if len(at) else at
        length = [automaton.match(hashes[a : min(e, a + automaton.end)].tolist()) for a, e in zip(at.tolist(), ends.tolist())]
        hit = np.array(length, np.int64) > 0
        yield at[hit], at[hit] + np.array(length, np.int64)[hit], nr


def scan(docs: DataFrame, phrases=None, templates=None, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with n_words and ``matches``: label, template (else a phrase), first_word, end_word of each match."""
    small_batches(docs)
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    wanted = [np.array([word_hash(w) for w in p.split()], np.uint64) for p in phrases]
    automata = [compiled(t) for t in templates.values()]
    labels = np.array([*phrases.values(), *templates])
    plain = len(phrases)
    rest = without(docs, text, "n_words", "matches").columns
    match = T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("template", T.BooleanType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
        ]
    )
    schema = T.StructType(
        [*(docs.schema[c] for c in rest), T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(match))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnp.utf8(batch.column(len(rest)))
            counts, cols = np.zeros(len(batch), np.int64), [[np.zeros(0, np.int64)] for _ in range(4)]
            for a, b in textnp.runs(offsets):
                hashes, first = textnp.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], textnp.ALNUM)
                counts[a:b] = np.diff(first)
                for start, end, nr in _found(hashes, first, wanted, automata):
                    doc = np.searchsorted(first, start, side="right") - 1
                    for col, x in zip(cols, (a + doc, start - first[doc], end - first[doc], np.full(len(start), nr))):
                        col.append(x)
            doc, start, end, nr = (np.concatenate(c) for c in cols)
            order = np.lexsort((nr, start, doc))
            doc, start, end, nr = doc[order], start[order], end[order], nr[order]
            struct = pa.StructArray.from_arrays(
                [pa.array(labels[nr].astype(object), pa.string()), pa.array(nr >= plain), pa.array(start), pa.array(end)],
                ["label", "template", "first_word", "end_word"],
            )
            at = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts), pa.ListArray.from_arrays(at, struct)], [*rest, "n_words", "matches"]
            )

    return docs.select(*(docs[c] for c in rest), docs[text]).mapInArrow(textnp.tidy(run), schema)


def joined(matches: Column) -> Column:
    """Distinct labels of matches, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def as_pattern(template: str) -> str:
    """The template as a regular expression over words joined by single spaces; an independent form for tests and SQL."""

    def render(tree: list) -> str:
        out = ""
        for part in tree:
            if isinstance(part, str):
                out += f" {part}"
            elif isinstance(part, int):
                out += f"(?: [^ ]+){{0,{part}}}"
            else:
                out += f"(?:{render(part)})?"
        return out

    return f"{render(parse(template))}(?: |$)"
