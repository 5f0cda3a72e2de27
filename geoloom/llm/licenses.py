"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text and, for notices wrapped over lines, its windows of as many words as the
template has; templates are sets of words. A block matches when it holds at least
``threshold`` of a template's words. Template words are ordered by how many texts of the whole table hold
them, rarest first; a block that matches must hold one of the template's first |T| - a + 1 words
(a: the least overlap), have a words or more, and from the first shared word on leave room for a shared
words. Only blocks that pass all three filters are counted out.

Beside it, the base phrases are located exactly, with their places.

Defined results: a null or empty text has no words and no labels; every row gives one result row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening words of public license notices, and the labels they give.
TEMPLATES = {
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "lgpl-notice": "this library is free software under the gnu lesser general public license",
    "apache-notice": "licensed under the apache license version 2 0",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-notice": "licensed under cc by 4 0",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

#: Lower-cases A-Z and turns every byte outside [0-9a-z\x80-\xff] into a blank; line feeds go in LINES only.
WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LINES = bytes(10 if b == 10 else WORDS[b] for b in range(256))


def token_counts(docs: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """How many texts of the whole table hold each word of the templates; the driver gets one row a word."""

    def make():
        def step(batch):
            seen: dict[bytes, int] = {}
            for x in batch.column(0):
                for w in vocabulary.intersection(x.as_buffer().to_pybytes().translate(WORDS).split()) if x.is_valid else ():
                    seen[w] = seen.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

        return step

    counted = map_arrow(docs.select(text), make, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r["w"]): r["n"] for r in counted.collect()}


class Index:
    """Templates in frequency order with an inverted index over their prefixes."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float):
        sets = {label: set(t.encode().split()) for label, t in templates.items()}
        words = sorted(set().union(*sets.values()), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(words)}
        self.templates = [(label, sorted(s, key=self.rank.__getitem__), math.ceil(threshold * len(s) - 1e-9)) for label, s in sets.items()]
        self.lists: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, ordered, least) in enumerate(self.templates):
            for at, w in enumerate(ordered[: len(ordered) - least + 1]):
                self.lists.setdefault(w, []).append((t, at))
        self.prefix = frozenset(self.lists)
        self.lengths = [len(t.split()) for t in templates.values()]

    def match(self, words: set[bytes]) -> dict[str, float]:
        """Labels and containments of the templates that a block of these words matches."""
        if not self.prefix & words:
            return {}
        own = sorted((w for w in words if w in self.rank), key=self.rank.__getitem__)
        tried: set[int] = set()
        found = {}
        for i, w in enumerate(own):
            for t, at in self.lists.get(w, ()):
                label, ordered, least = self.templates[t]
                if t in tried or len(words) < least:
                    continue
                tried.add(t)  # w is the first shared word: earlier ones of either order are not shared
                if 1 + min(len(ordered) - at - 1, len(own) - i - 1) < least:
                    continue
                n = sum(x in words for x in ordered)
                if n >= least:
                    found[label] = n / len(ordered)
        return found

    def windows(self, words: list[bytes]) -> dict[str, float]:
        """Labels and best containments of the templates that a window of the text's words matches, whatever its lines."""
        present, found = set(words), {}
        for (label, ordered, least), length in zip(self.templates, self.lengths, strict=True):
            own = present.intersection(ordered)
            if len(own) < least:
                continue
            places = [(i, w) for i, w in enumerate(words) if w in own]
            held: dict[bytes, int] = {}
            best = first = 0
            for i, w in places:
                held[w] = held.get(w, 0) + 1
                while places[first][0] <= i - length:
                    left = places[first][1]
                    first += 1
                    held[left] -= 1
                    if not held[left]:
                        del held[left]
                best = max(best, len(held))
            if best >= least:
                found[label] = best / len(ordered)
        return found


def base_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """Places (in words) and labels of the base phrases."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        at = line.find(phrase)
        while at >= 0:
            out.append((line.count(b" ", 0, at), label))
            at = line.find(phrase, at + 1)
    return out


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row a text: word count, base places and labels, the join's labels and the best containment."""
    vocabulary = frozenset(w for t in templates.values() for w in t.encode().split())
    index = Index(templates, token_counts(docs, vocabulary, text), threshold)
    phrases = {b" " + p.encode() + b" ": label for p, label in BASE.items()}
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]
    source = docs.select(key, text)
    key_type = source.schema[0].dataType.simpleString()

    def make():
        def one(raw: bytes):
            words = raw.translate(WORDS).split()
            known = index.prefix.intersection(words)
            places = base_places(words, phrases) if words else []
            labels, best = {label for _, label in places}, 1.0 if places else 0.0
            base = ",".join(sorted(labels))
            if known:
                blocks = (index.match(set(line.split())) for line in raw.translate(LINES).split(b"\n"))
                for matched in (*blocks, index.windows(words)):
                    for label, share in matched.items():
                        labels.add(label)
                        best = max(best, share)
            at = [p for p, _ in places]
            return len(words), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), best

        def step(batch):
            rows = [one(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [key, *names])

        return step

    return map_arrow(source, make, f"`{key}` {key_type}, {schema}")


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
