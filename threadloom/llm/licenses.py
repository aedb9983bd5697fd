"""License scans with a trained paragraph classifier.

A text's lines, its sentences (joined across the breaks of hard-wrapped lines) and overlapping windows of
its paragraphs are scored by a sparse logistic regression over word 1- to 3-grams. It knows the families
of ``TEMPLATES`` and an unknown class, learned from a bounded sample of the corpus's own text and from
shuffled template words; a temperature fitted on held-out variants calibrates the probabilities. Where the
unknown class does not lead, the wording around is set against the templates: the stretch that holds most
of one's word pairs stands if enough of them are there and the classifier names the same family for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.decontaminate import WORD, word_hashes
from threadloom.llm.shared import Shared, lean, small_slices

UNKNOWN = "unknown"
#: Family and wording of public licences and notices.
WORDINGS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
    ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("All-rights-reserved", "All rights reserved."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991. Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999. Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Copyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007. Copyright (C) 2007 Free Software Foundation, Inc."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License Version 2.0. 1. Definitions. 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("CC0", "Creative Commons Legal Code. CC0 1.0 Universal. CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES."),
)
#: Short names and identifiers of the families.
NAMES = (
    ("MIT", ("MIT License",)),
    ("Apache-2.0", ("Apache License 2.0", "Apache 2.0 License")),
    ("GPL-2.0", ("GNU General Public License v2.0", "GNU GPL version 2", "GPLv2")),
    ("GPL-3.0", ("GNU General Public License v3.0", "GNU GPL version 3", "GPLv3")),
    ("LGPL", ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License v3.0", "LGPLv2.1", "LGPLv3")),
    ("AGPL-3.0", ("GNU Affero General Public License v3.0", "AGPLv3")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "New BSD License")),
    ("ISC", ("ISC License",)),
    ("MPL-2.0", ("Mozilla Public License 2.0", "MPL 2.0")),
)
IDENTIFIERS = (
    ("MIT", ("MIT",)),
    ("Apache-2.0", ("Apache-2.0",)),
    ("GPL-2.0", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later")),
    ("GPL-3.0", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")),
    ("LGPL", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    ("AGPL-3.0", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    ("BSD-2-Clause", ("BSD-2-Clause",)),
    ("BSD-3-Clause", ("BSD-3-Clause",)),
    ("ISC", ("ISC",)),
    ("MPL-2.0", ("MPL-2.0",)),
    ("CC-BY", ("CC-BY-3.0", "CC-BY-4.0")),
    ("CC-BY-SA", ("CC-BY-SA-3.0", "CC-BY-SA-4.0")),
    ("CC-BY-NC", ("CC-BY-NC-3.0", "CC-BY-NC-4.0")),
    ("CC0", ("CC0-1.0",)),
    ("Unlicense", ("Unlicense",)),
)
CREATIVE = (("CC-BY", "Attribution", "BY"), ("CC-BY-SA", "Attribution-ShareAlike", "BY-SA"), ("CC-BY-NC", "Attribution-NonCommercial", "BY-NC"))
VERSIONS = (("2.0", "Generic"), ("3.0", "Unported"), ("4.0", "International"))
FRAMES = ("available under the {}", "distributed under the terms of the {}", "licensed under the {}")
IDENTIFIER = "SPDX-License-Identifier: {}"
#: Licences outside of the families; with the frames they teach the unknown class what the name decides.
OTHERS = ("Boost Software License 1.0", "zlib License", "Eclipse Public License v2.0", "European Union Public Licence v1.2", "Artistic License 2.0", "SIL Open Font License 1.1", "Common Development and Distribution License 1.0", "license", "terms of this agreement")
OTHER_IDENTIFIERS = ("BSL-1.0", "Zlib", "EPL-2.0", "EUPL-1.2", "Artistic-2.0", "OFL-1.1", "CDDL-1.0", "WTFPL", "NCSA")
TEMPLATES = (
    *WORDINGS,
    *((family, IDENTIFIER.format(x)) for family, names in IDENTIFIERS for x in names),
    *((family, FRAMES[0].format(x)) for family, names in NAMES for x in names),
    *((family, f"Creative Commons {kind} {version} {where} License") for family, kind, _ in CREATIVE for version, where in VERSIONS),
    *((family, f"licensed under CC {code} {version}") for family, _, code in CREATIVE for version, _ in VERSIONS[:2]),
)
NEAR_MISSES = (
    *(IDENTIFIER.format(x) for x in OTHER_IDENTIFIERS),
    *(frame.format(x) for frame in FRAMES for x in OTHERS),
    "SPDX-License-Identifier", "available under the", "Creative Commons", "Creative Commons License", "GNU Free Documentation License", "General Public License", "Public License version 2.0",
)
BREAK = re.compile(r"\n[^\S\n]*\n\s*")
SENTENCE = re.compile(r"(?<=[.!?;:])\s+")
NGRAMS = 3
#: Words of the overlapping windows and their distance.
WINDOWS = ((40, 20), (12, 6))
MARGIN = 40
#: Characters of a line that the model learns from at most.
LINE_LETTERS = 2000


@dataclass
class Model:
    """weight[feature, class]; the last feature is the share of n-grams outside the vocabulary."""

    families: list[str]
    vocabulary: np.ndarray  # sorted n-gram hashes
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[tuple[int, int]]  # class and number of distinct word pairs
    holders: dict[int, list[int]] = field(default_factory=dict)  # word pair -> templates that hold it


def ngram_hashes(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the runs of 1, 2 and 3 words that start at each word."""
    out, h = [words], words
    for n in range(1, NGRAMS):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
        out.append(h)
    return out


def window_features(vocabulary: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram order: the places whose n-gram is in the vocabulary, and its number there."""
    out = []
    for h in ngram_hashes(words):
        at = np.searchsorted(vocabulary, h).clip(0, max(len(vocabulary) - 1, 0))
        place = np.flatnonzero(vocabulary[at] == h) if len(vocabulary) else np.zeros(0, np.int64)
        out.append((place, at[place]))
    return out


def sums(values: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window the sum of ``values`` at the places in ``[start, end)``, and how many those are."""
    upto = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    low = np.searchsorted(place, start)
    high = np.maximum(np.searchsorted(place, end), low)
    return upto[high] - upto[low], high - low


def logits(m: Model, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class logits of the windows ``[start, end)`` of a run of words."""
    total, inside = np.zeros(len(start)), np.zeros(len(start))
    out = np.zeros((len(start), len(m.families)))
    for n, (place, number) in enumerate(window_features(m.vocabulary, words)):
        part, count = sums(m.weight[number], place, start, end - n)
        out, inside, total = out + part, inside + count, total + np.maximum(end - start - n, 0)
    total = np.maximum(total, 1)
    return (m.bias + 8.0 * out / total[:, None] + 8.0 * (1 - inside / total)[:, None] * m.weight[-1]) / m.temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Hash of each word with the next."""
    return words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]


def _variants(words: list[int], noise: list[int], rng: np.random.Generator, count: int) -> Iterator[list[int]]:
    """The wording itself, and stretches of it with words lost and strange words around."""
    yield list(words)
    for k in range(count):
        n = len(words)
        size = n if k % 3 == 0 else int(rng.integers(max(2, min(n, max(8, n // 2))), n + 1))
        a = int(rng.integers(0, n - size + 1))
        own = [w for w in words[a : a + size] if rng.random() > 0.05]
        extra = [noise[int(j)] for j in rng.integers(0, len(noise), int(rng.integers(0, 1 + len(own) // 2)))] if noise else []
        cut = int(rng.integers(0, len(extra) + 1))
        yield extra[:cut] + own + extra[cut:]


def train(corpus: list[str], variants: int = 24, steps: int = 120, seed: int = 3) -> Model:
    """Fit on the templates' variants and, as unknown, ``NEAR_MISSES``, shuffled template words, and lines of the corpus that no template resembles.

    Of such a line the first 40 words are learned from, the length of the longest window; 5,000 of their words surround the variants.
    """
    rng, cache = np.random.default_rng(seed), {}
    families = [UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES)]
    wordings = [(families.index(f), word_hashes(t, cache)) for f, t in TEMPLATES]
    pairs = [np.unique(pairs_of(np.array(w, np.uint64))) for _, w in wordings]
    holders: dict[int, list[int]] = {}
    for k, own in enumerate(pairs):
        for p in own.tolist():
            holders.setdefault(p, []).append(k)
    known = [h for _, w in wordings for h in w]
    plain = [w for p in corpus if len(w := word_hashes(p, cache)) > 1 and np.mean([p in holders for p in pairs_of(np.array(w, np.uint64)).tolist()]) < 0.3]
    noise = sorted({h for p in plain for h in p})[:5000]
    examples = [(c, v) for c, w in wordings for v in _variants(w, noise, rng, variants) if v]
    examples += [(c, v) for family, names in NAMES for x in names for frame in FRAMES for c in [families.index(family)] for v in _variants(word_hashes(frame.format(x), cache), noise, rng, variants // 4)]
    misses = [word_hashes(x, cache) for x in NEAR_MISSES]
    examples += [(0, v) for w in misses for v in _variants(w, noise, rng, variants // 2) if v]
    frames = [word_hashes(x.format(""), cache) for x in (*FRAMES, IDENTIFIER)]
    examples += [(0, frames[k % len(frames)] + [noise[int(j)] for j in rng.integers(0, len(noise), int(rng.integers(1, 4)))]) for k in range(variants * 4 if noise else 0)]
    examples += [(0, p[:40]) for p in plain[: variants * len(WORDINGS)]]
    examples += [(0, [known[int(k)] for k in rng.integers(0, len(known), int(rng.integers(2, 20)))]) for _ in range(variants * 16)]
    vocabulary = np.unique(np.concatenate([h for w in (*(w for _, w in wordings), *misses) for h in ngram_hashes(np.array(w, np.uint64))]))
    y = np.array([c for c, _ in examples])
    x = np.zeros((len(examples), len(vocabulary) + 1), np.float32)
    for k, (_, w) in enumerate(examples):
        found = window_features(vocabulary, np.array(w, np.uint64))
        total = sum(max(len(w) - n, 0) for n in range(NGRAMS))
        for _, number in found:
            np.add.at(x[k], number, 8.0 / total)
        x[k, -1] = 8.0 * (1 - sum(len(p) for p, _ in found) / total)
    held = rng.random(len(examples)) < 0.15
    target = np.eye(len(families), dtype=np.float32)[y]
    weight, bias = np.zeros((x.shape[1], len(families)), np.float32), np.zeros(len(families), np.float32)
    xa, ta = x[~held], target[~held]
    m1, m2 = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, steps + 1):
        g = (_softmax(xa @ weight + bias) - ta) / len(xa)
        gw = xa.T @ g + 1e-5 * weight
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        weight -= 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
        bias -= 0.5 * g.sum(axis=0)
    z, t = x[held] @ weight + bias, y[held]
    grid = np.geomspace(0.25, 4, 33)
    losses = [-np.log(_softmax(z / c)[np.arange(len(t)), t] + 1e-9).mean() for c in grid] if len(t) else [0.0]
    return Model(families, vocabulary, weight, bias, float(grid[int(np.argmin(losses))]), [(c, len(p)) for (c, _), p in zip(wordings, pairs, strict=True)], holders)


@dataclass
class Layout:
    """A text's words, and the places where its lines, sentences and paragraphs end."""

    words: list[int]
    lines: list[int]
    sentences: list[int]
    paragraphs: list[int]


def lay_out(text: str, cache: dict[str, int]) -> Layout:
    out = Layout([], [], [], [])
    for paragraph in BREAK.split(text):
        for line in paragraph.split("\n"):
            parts = SENTENCE.split(line)
            for k, part in enumerate(parts):
                out.words += word_hashes(part, cache)
                if k + 1 < len(parts) or part[-1:] in ".!?;:":
                    out.sentences.append(len(out.words))
            out.lines.append(len(out.words))
        out.sentences.append(len(out.words))
        out.paragraphs.append(len(out.words))
    return out


def windows(layout: Layout, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's lines, sentences, and the ``WINDOWS`` of its paragraphs."""
    starts, ends = [], []
    for marks in (layout.lines, layout.sentences):
        end = np.unique(np.array(marks, np.int64))
        starts.append(np.r_[0, end[:-1]])
        ends.append(end)
    end = np.unique(np.array(layout.paragraphs, np.int64))
    for a, b in zip(np.r_[0, end[:-1]].tolist(), end.tolist(), strict=True):
        for size, stride in WINDOWS:
            at = np.arange(a, max(a + 1, b - stride), stride)
            starts.append(at)
            ends.append(np.minimum(at + size, b))
    a, b = np.concatenate(starts), np.concatenate(ends)
    kept = b - a > 1
    return a[kept] + base, b[kept] + base


def stretches(m: Model, words: np.ndarray, least: float, gap: int = 10) -> list[tuple[float, int, int, int, int]]:
    """``(share, pairs held, class, start, end)`` of each template's best stretch in a run of words: pair places up to ``gap`` apart."""
    places: dict[int, list[tuple[int, int]]] = {}
    for k, p in enumerate(pairs_of(words).tolist()):
        for t in m.holders.get(p, ()):
            places.setdefault(t, []).append((k, p))
    out = []
    for t, own in places.items():
        family, size = m.templates[t]
        if len(own) < least * size:
            continue
        cuts = [0, *(k for k in range(1, len(own)) if own[k][0] - own[k - 1][0] > gap), len(own)]
        held, a, b = max((len({p for _, p in own[i:j]}), own[i][0], own[j - 1][0] + 2) for i, j in zip(cuts, cuts[1:], strict=False))
        if held >= least * size:
            out.append((held / size, held, family, a, b))
    return sorted(out, key=lambda x: (-round(x[0], 2), -x[1], x[3], x[2]))


def confirmed(m: Model, words: np.ndarray, least_probability: float, least_similarity: float) -> list[tuple[int, int, int, float, float]]:
    """``(start, end, class, probability, similarity)`` of a run's stretches that a template and the classifier agree on, none overlapping."""
    out: list[tuple[int, int, int, float, float]] = []
    for share, _, family, a, b in stretches(m, words, least_similarity):
        if any(a < e and s < b for s, e, *_ in out):
            continue
        p = _softmax(logits(m, words, np.array([a]), np.array([b])))[0]
        if int(p.argmax()) == family and p[family] >= least_probability:
            out.append((a, b, family, float(p[family]), share))
    return sorted(out)


def classify(m: Model, texts: list[str], cache: dict[str, int], least_probability: float, least_similarity: float) -> list[tuple[int, int, int, str, float, float]]:
    """``(text, first word, words, family, probability, similarity)`` of every notice found."""
    layouts = [lay_out(t, cache) for t in texts]
    sizes = np.array([len(x.words) for x in layouts], np.int64)
    base = np.cumsum(sizes) - sizes
    words = np.fromiter((w for x in layouts for w in x.words), np.uint64, int(sizes.sum()))
    if not len(words):
        return []
    start, end = (np.concatenate(x) for x in zip(*(windows(x, b) for x, b in zip(layouts, base.tolist(), strict=True) if x.words), strict=True))
    place, number = window_features(m.vocabulary, words)[1]
    some = np.searchsorted(place, end - 1) > np.searchsorted(place, start)  # without a template's word pair nothing can be confirmed
    start, end = start[some], end[some]
    if not len(start):
        return []
    near = _softmax(logits(m, words, start, end))[:, 0] < 0.5
    start, end = start[near], end[near]
    owner = np.searchsorted(base, start, side="right") - 1
    out = []
    for k in np.unique(owner).tolist():
        own = owner == k
        low, high = base[k], base[k] + sizes[k]
        spans = sorted(zip(np.maximum(start[own] - MARGIN, low).tolist(), np.minimum(end[own] + MARGIN, high).tolist(), strict=True))
        regions = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= regions[-1][1]:
                regions[-1][1] = max(b, regions[-1][1])
            else:
                regions.append([a, b])
        for a, b in regions:
            for s, e, family, p, share in confirmed(m, words[a:b], least_probability, least_similarity):
                out.append((k, int(a + s - low), e - s, m.families[family], p, share))
    return out


def wording(text: str, first: int, count: int) -> str:
    """The text from its word ``first`` on, ``count`` words long."""
    spans = [w.span() for k, w in zip(range(first + count), WORD.finditer(text), strict=False) if k >= first]
    return text[spans[0][0] : spans[-1][1]]


def fit(docs: DataFrame, fit_docs: int = 500, **options) -> Model:
    """Train with lines of about ``fit_docs`` documents, chosen by the hash of their ids, as the unknown class.

    Of a line its first ``LINE_LETTERS`` characters are taken. Null texts give none, repeated rows count each; without a document the unknown class is learned from shuffled template words alone.
    """
    usable = docs.where("text IS NOT NULL")
    part = int(min(1.0, fit_docs / max(usable.count(), 1)) * (1 << 30))
    lines = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < part).select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    lines = lines.select(F.left("line", F.lit(LINE_LETTERS)).alias("line"))
    rows = lines.orderBy(F.xxhash64("line"), "line").limit(20 * fit_docs).collect()
    return train([r.line for r in rows], **options)


def scan(docs: DataFrame, model: Model, least_probability: float = 0.5, least_similarity: float = 0.6) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, first_word, n_words, family, probability, similarity, text)`` of the notices found.

    Words are runs of word characters, numbered from 0. A licence of many paragraphs gives a row for each passage that a
    template covers. Null and empty texts have none. Repeated rows are all scanned; extra columns are ignored; an empty
    table gives an empty result.
    """
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in small_slices(batches, "text", 500, 4 << 20):
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            found = classify(shared.value, [t or "" for t in texts], cache, least_probability, least_similarity)
            rows = [(ids[k], first, n, family, p, share, wording(texts[k], first, n)) for k, first, n, family, p, share in found]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string()]
                names = ["doc_id", "first_word", "n_words", "family", "probability", "similarity", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, first_word int, n_words int, family string, probability double, similarity double, text string")
