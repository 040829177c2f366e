"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased words of letters and digits, with five-word shingles (a shorter template is one
shingle of its own length). Windows of 2**j shingles, stepping by a quarter, are signed by BANDS bands of one hash each: a
template of t shingles is sought in the windows of the two sizes from 4/3 t on, and any passage of that length lies whole
in one of them, where its share is at least 3/8. A window that holds 0.8 of a template's shingles shares a band with it
with probability of 1 - (1 - 0.8 * 3/8)**BANDS at least, over 0.99999. The candidate's shingles are then looked up in the
text around the window, and a match is reported where the best stretch of the template's length holds 0.8 of them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, CONTAINMENT = 5, 36, 0.8

#: Names and notices of common licenses, in the words of their own stewards' short forms.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."],
}

_WORDS = re.compile(r"[^\W_]+")
_SEEDS = np.random.Generator(np.random.PCG64(31)).integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    w = _WORDS.findall((text or "").lower())
    return np.array(list(map(_HASHES.__getitem__, w)), np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ words[i : i + len(out)]) * _MULT
            out ^= out >> np.uint64(29)
    return out


def _signatures(sh: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = sh[None, :] * _SEEDS[:, None]
    return x ^ (x >> np.uint64(32))


class Templates:
    """Templates by shingle size and window size, with their band keys sorted."""

    def __init__(self, templates: dict[str, list[str]]):
        self.items = []
        for name in sorted(templates):
            for i, text in enumerate(templates[name]):
                w = word_hashes(text)
                size = min(SHINGLE, len(w))
                if size:
                    self.items.append((name, i, size, shingles(w, size), len(w)))
        self.by_size: dict[int, dict[int, tuple]] = {}
        for k, (_, _, size, sh, _) in enumerate(self.items):
            least = max(4, int(np.ceil(len(sh) * 4 / 3)))
            first = 1 << int(np.ceil(np.log2(least)))
            own = self.by_size.setdefault(size, {})
            for window in (first, 2 * first):
                own.setdefault(window, []).append((k, _signatures(sh).min(axis=1)))
        for own in self.by_size.values():
            for window, members in own.items():
                band = np.concatenate([np.arange(BANDS)] * len(members))
                value = np.concatenate([m for _, m in members])
                owner = np.repeat([k for k, _ in members], BANDS)
                keys = [np.sort(value[band == b]) for b in range(BANDS)]
                owners = [owner[band == b][np.argsort(value[band == b], kind="stable")] for b in range(BANDS)]
                table = np.zeros((BANDS, 1 << 16), bool)  # of the first 16 bits of the keys
                table[band, (value >> np.uint64(48)).astype(np.int64)] = True
                own[window] = (keys, owners, table)

    def candidates(self, sh: np.ndarray, size: int):
        """(template, first shingle, last shingle) of windows that share a band."""
        found = set()
        n = len(sh)
        for a in range(0, n, 1 << 15):
            # windows that begin in this stretch
            windows = self.by_size[size]
            part = sh[a : a + (1 << 15) + max(windows)]
            sig = _signatures(part)
            for window, (keys, owners, table) in windows.items():
                hop = window // 4
                pad = -len(part) % hop
                x = np.pad(sig, ((0, 0), (0, pad)), constant_values=np.iinfo(np.uint64).max) if pad else sig
                low = x.reshape(BANDS, -1, hop).min(axis=2) if hop > 1 else x
                m = max(1, low.shape[1] - 3)
                whole = low[:, :m].copy()
                for i in range(1, min(4, low.shape[1])):
                    np.minimum(whole, low[:, i : i + m], out=whole)
                maybe = table[np.arange(BANDS)[:, None], (whole >> np.uint64(48)).astype(np.int64)]
                for b, w in zip(*(y.tolist() for y in np.nonzero(maybe)), strict=True):
                    value = whole[b, w]
                    j = int(np.searchsorted(keys[b], value))
                    while j < len(keys[b]) and keys[b][j] == value:
                        found.add((int(owners[b][j]), a + w * hop, min(n, a + w * hop + window)))
                        j += 1
        return found

    def scan(self, texts: list[str | None]) -> list[tuple[int, str, int, int, int, float]]:
        """(text number, license, template number, first word, last word + 1, containment), disjoint stretches of each
        template. The texts' shingles are searched as one row; what is found is verified within each text."""
        words = [word_hashes(t) for t in texts]
        out = []
        for size in self.by_size:
            own = [shingles(w, size) for w in words]
            ends = np.cumsum([len(x) for x in own])
            sh = np.concatenate(own) if own else np.empty(0, np.uint64)
            stretches: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for k, a, b in self.candidates(sh, size):
                d = int(np.searchsorted(ends, a, side="right"))
                while d < len(own) and ends[d] - len(own[d]) < b:
                    base = int(ends[d]) - len(own[d])
                    if len(own[d]):
                        stretches.setdefault((d, k), []).append((max(0, a - base), min(len(own[d]), b - base)))
                    d += 1
            for (d, k), parts in stretches.items():
                name, i, _, want, n_words = self.items[k]
                merged: list[list[int]] = []
                for a, b in sorted(parts):
                    a, b = max(0, a - len(want)), min(len(own[d]), b + len(want))
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    out += [(d, name, i, x, min(x + n_words, len(words[d])), c) for x, c in _verify(own[d][a:b], want, a)]
        return sorted(out)


def _verify(sh: np.ndarray, want: np.ndarray, base: int) -> list[tuple[int, float]]:
    """Starts of disjoint stretches of the template's length that hold CONTAINMENT of its different shingles, best first."""
    names = np.unique(want)
    at = np.minimum(np.searchsorted(names, sh), len(names) - 1)
    hit = names[at] == sh
    t, out, done = len(want), [], np.zeros(len(sh), bool)
    where = np.flatnonzero(hit)
    need = CONTAINMENT * len(names)
    scored = []
    for s in where:
        own = at[s : s + t][hit[s : s + t]]
        if len(own) >= need - 1e-9:
            n = len(np.unique(own))
            if n >= need - 1e-9:
                scored.append((-n, int(s)))
    for n, s in sorted(scored):
        if not done[s : s + t].any():
            done[s : s + t] = True
            out.append((base + s, -n / len(names)))
    return out


def _scan(sent):
    def run(batches):
        own = Templates(sent.value)
        for b in batches:
            rows = []
            docs = b.column(0).to_pylist()
            for at in range(0, b.num_rows, 64):
                rows += [(docs[at + d], *m) for d, *m in own.scan(b.column(1).slice(at, 64).to_pylist())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["doc_id", "license", "template", "first_word", "end_word", "containment"])

    return run


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, template, first_word, end_word, containment: a row for each match; texts without one give none.

    Whole texts are scanned. Null and empty texts match nothing; rows with a null or repeated doc_id are scanned each;
    of equally good stretches that overlap the first is reported; other columns are ignored. Templates are a fixed list
    that goes to every task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _scan(sent), "doc_id long, license string, template int, first_word long, end_word long, containment double")
