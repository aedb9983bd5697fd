"""Trained operators: gradients, held-out accuracy on planted signals, and edge cases."""

import zlib

import numpy as np
import pytest

from threadloom.llm import language, licenses, toxicity

RNG = np.random.default_rng(0)
SYLLABLES = {"aa": ["tho", "ing", "er", "wh"], "bb": ["ção", "ñe", "el", "que"], "cc": ["sch", "ung", "ei", "pf"]}


def sentence(lang, n=12):
    return " ".join("".join(RNG.choice(SYLLABLES[lang], int(RNG.integers(1, 4)))) for _ in range(n)).capitalize() + "."


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, sentence(lang), lang) for i, lang in enumerate(list(SYLLABLES) * 80)]
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "bb"), (1002, "", None), (None, sentence("cc"), "cc"), (3, sentence("aa"), None), (1003, sentence("bb", 100_000), None), (1004, "² ½ ①", "aa"), (1005, "_ 12", "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.5D AS score", "'x' AS source")


def test_gradients_match_differences():
    m = language.new_tagger(["x", "y"], 3, 1)
    for name in ("table", "recur", "out", "bias"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    spans, labels = RNG.integers(97, 100, (4, 5)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = language.gradients(m, spans, labels)
    for p, g in zip((m.table, m.recur, m.out, m.bias), grads, strict=True):
        for at in [tuple(int(RNG.integers(n)) for n in p.shape) for _ in range(6)] + ([(0, 98, 1), (1, 97, 4)] if p is m.table else []):
            old, e = p[at], 1e-4
            p[at] = old + e
            up = language.gradients(m, spans, labels)[0]
            p[at] = old - e
            down = language.gradients(m, spans, labels)[0]
            p[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3


def test_language_is_learned_from_text_alone(docs):
    model = language.fit(docs, steps=150)
    rows = language.predict(docs, model).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None and r.doc_id < 240 and r.lang}
    mine = [(truth[r.doc_id], r.lang_pred) for r in rows if r.doc_id in truth and r.doc_id != 3 and held(r.doc_id)]
    assert np.mean([a == b for a, b in mine]) > 0.95
    und = {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (1000, 1001, 1002, 1004, 1005)}
    assert set(und.values()) == {("und", 0.0)}
    assert [r.lang_pred for r in rows if r.doc_id == 1003] == ["bb"]
    assert all(0 <= r.score <= 1 for r in rows)
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert not {r.doc_id for r in kept.collect()} & {1000, 1001, 1002, 1004, 1005}


def test_positions_equal_the_plain_recursion():
    m = language.train([(b"the cat sat on", "a"), (b"der hund ist b", "b"), (b"th", "a")], hidden=5, steps=5, rows=4)
    texts = ["", "a", "thé cat 12! ", "x" * language.CHUNK, "the cat sat on der hund " * 40]
    raw = [t.encode() for t in texts]
    got = language.pooled(language.Reader(m), raw)
    for t, p in zip(raw, got, strict=True):
        total = np.zeros(2)
        for own in range(0, len(t), language.CHUNK):
            read = max(0, own - language.CONTEXT)
            part = np.frombuffer(t[read : own + language.CHUNK + language.CONTEXT], np.uint8)[None, :]
            q, _, _ = language.forward(m, part)
            total += q[own - read : own - read + language.CHUNK, 0].sum(axis=0)
        assert np.allclose(p, total / max(len(t), 1), atol=1e-4)


def test_reading_takes_no_hyperbolic_tangents(monkeypatch):
    m = language.train([(b"the cat sat on", "a"), (b"der hund ist b", "b"), (b"th", "a")], hidden=5, steps=5, rows=4)
    raw = [b"the cat", b"x" * 400]
    want = language.pooled(language.Reader(m), raw)
    monkeypatch.setattr(np, "tanh", None)
    assert (language.pooled(language.Reader(m), raw) == want).all()
    whole = language.Reader(m).probabilities(np.array([list(raw[0]) + [language.PAD] * 9]))[:7, :, 0]
    assert np.allclose(whole, language.forward(m, np.frombuffer(raw[0], np.uint8)[None, :])[0][:, 0], atol=1e-6)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert language.fit(docs) is None
    assert language.predict(docs, None).first().lang_pred == "und"
    assert language.predict(docs.limit(0), None).collect() == []


def test_toxicity_held_out(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = sentence("aa", 20).split()
        if toxic:
            words[3:3] = ["Scoundrel", "scoundrels!"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "SCOUNDREL " * 5000), (None, "a scoundrel"), (1, rows[1][1])]
    labels += [(1, 0), (777, 1), (None, 1), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS score")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'t' AS text")
    model = toxicity.fit(docs, marks)
    scores = [(r.doc_id, r.score) for r in toxicity.predict(docs, model).collect()]
    assert len(scores) == len(rows)
    truth = dict(labels[:400])
    test = [(truth[i], s >= 0.5) for i, s in scores if i in truth and held(i)]
    assert np.mean([bool(a) == b for a, b in test]) > 0.97
    by = dict(scores)
    assert by[900] == by[901] and 0 < by[901] < 0.5 < by[902]
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 902 not in {r.doc_id for r in kept.collect()}


def test_toxicity_scores_equal_plain_ones():
    words = {"calm": 0, "scoundrel": 1, "kind": 0, "villain": 1}
    rows = [(w, label) for w, label in words.items() for _ in range(5)]
    known = sorted({g for w in words for g in toxicity.gram_ids(w)})
    ratios = {g: (1.0 if k % 2 else -0.5) for k, g in enumerate(known)}
    model = toxicity.train([(label, sorted(set(toxicity.gram_ids(w)))) for w, label in rows], ratios)
    texts = ["Scoundrel, scoundrel!", "kind", "", None, "a villain " * 50_000]
    import pyarrow as pa

    found = [f for _, part in toxicity._features(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), model.known) for f in part]
    for t, got in zip(texts, toxicity._scores(found, model), strict=True):
        present = {zlib.crc32(w[k : k + n]) % toxicity.BUCKETS for x in set((t or "").lower().replace(",", " ").replace("!", " ").split()) for w in [f"^{x}$".encode()] for n in range(2, 7) for k in range(len(w) - n + 1)}
        assert abs(got - 1 / (1 + np.exp(-model.bias - sum(model.weight.get(b, 0.0) for b in present)))) < 1e-9


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert toxicity.predict(docs, None).first().score == 0


#: Public notices as they stand in files, and their families.
NOTICES = (
    ("GPL-2.0", "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version."),
    ("GPL-3.0", "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", " * it under the terms of the GNU Affero General Public License as\n * published by the Free Software Foundation, either version 3 of the\n * License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software."),
    ("BSD", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"),
    ("Apache-2.0", "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License."),
)


def test_license_families(spark):
    rows = [(1000 + i, "\n".join(sentence("aa") for _ in range(4)) + "\n" + text) for i, (_, text) in enumerate(licenses.TEMPLATES)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "We like the general idea of a license to redistribute software."), (104, sentence("bb", 30_000)), (1000, rows[0][1])]
    rows += [(105, f"{sentence('aa', 60)[:-1]} Licensed under the Apache License, Version 2.0 by thoing erwh {sentence('bb', 60)}")]
    rows += [(200 + 3 * k + j, lead + text + tail) for k, (_, text) in enumerate(NOTICES) for j, (lead, tail) in enumerate((("", ""), (sentence("aa", 80) + " ", " " + sentence("aa", 80)), (sentence("bb") + "\n\n", "\n\n" + sentence("cc"))))]
    rows += [(300, "\n".join([NOTICES[4][1], "", NOTICES[8][1]])), (301, " ".join(["license"] * 5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS family", "1 AS n_words")
    found = licenses.scan(docs, licenses.fit(docs)).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add(r.family)
    assert np.mean([by.get(1000 + i) == {family} for i, (family, _) in enumerate(licenses.TEMPLATES)]) > 0.9
    assert all(by.get(200 + 3 * k + j) == {family} for k, (family, _) in enumerate(NOTICES) for j in range(3))
    assert by[300] == {"MIT", "Apache-2.0"} and by[105] == {"Apache-2.0"}
    assert not set(by) & {100, 101, 102, 103, 104, 301}
    assert sum(r.doc_id == 1000 for r in found) == 2
    texts = dict(rows)
    for r in found:
        assert r.text in texts[r.doc_id] and len(licenses.WORD.findall(r.text)) == r.n_words and 0.6 <= r.similarity <= 1 and 0.5 <= r.probability <= 1
    assert licenses.scan(docs.limit(0), licenses.train([])).collect() == []


def test_window_scores_equal_plain_ones():
    m = licenses.train(["some plain words here", "and others there"], variants=4, steps=10)
    words = np.array(licenses.word_hashes(" ".join(t for _, t in licenses.TEMPLATES[:6]) + " some plain words", {}), np.uint64)
    start = RNG.integers(0, len(words) - 2, 40)
    end = np.minimum(start + RNG.integers(2, 40, 40), len(words))
    number = {int(h): k for k, h in enumerate(m.vocabulary)}
    for a, b, got in zip(start, end, licenses.logits(m, words, start, end), strict=True):
        grams = [int(h) for part in licenses.ngram_hashes(words[a:b]) for h in part]
        known = [number[g] for g in grams if g in number]
        want = m.bias + 8 * m.weight[known].sum(axis=0) / len(grams) + 8 * (1 - len(known) / len(grams)) * m.weight[-1]
        assert np.allclose(got, want / m.temperature, atol=1e-4)


@pytest.fixture(scope="module")
def scanner():
    rng = np.random.default_rng(1)
    stock = ["".join(rng.choice(SYLLABLES["aa"] + SYLLABLES["cc"], int(rng.integers(1, 4)))) for _ in range(300)]
    return licenses.train([" ".join(rng.choice(stock, int(rng.integers(4, 40)))) for _ in range(1500)])


def families(m, text):
    return {f for _, _, _, f, _, _ in licenses.classify(m, [text], {}, 0.5, 0.6)}


MENTIONS = [
    ("MIT", "// SPDX-License-Identifier: MIT"), ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-only"), ("LGPL", "/* SPDX-License-Identifier: LGPL-2.1-or-later */"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "This code is available under the MIT License, see LICENSE"), ("GPL-3.0", "It is distributed under the terms of the GNU General Public License v3.0."), ("BSD-3-Clause", "Code is licensed under the BSD 3-Clause License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.,\n51 Franklin Street, Fifth Floor, Boston"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc."),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("CC-BY", "Creative Commons Attribution 3.0 Unported"), ("CC-BY-SA", "under a Creative Commons Attribution-ShareAlike 3.0 Unported License"), ("CC-BY-NC", "Creative Commons Attribution-NonCommercial 2.0 Generic License"), ("CC-BY-SA", "Licensed under CC BY-SA 3.0"),
]


def test_short_mentions_and_heads_of_full_texts(scanner):
    got = [(family, families(scanner, f"Some words before it.\n{text}\nAnd after.")) for family, text in MENTIONS]
    assert all(found == {family} for family, found in got), got


@pytest.mark.parametrize(
    "text",
    [
        "SPDX-License-Identifier: PostgreSQL", "SPDX-License-Identifier: MS-PL", "available under the PostgreSQL License", "licensed under the Python Software Foundation License Version 2", "Microsoft Public License (Ms-PL)",
        "distributed under the terms of the Academic Free License v3.0", "GNU Free Documentation License, Version 1.3", "licensed under a private agreement", "The creative commons is a nice idea", "available under the counter",
    ],
)
def test_none_of_these(scanner, text):
    assert families(scanner, text) == families(scanner, f"We say: {text}. More words follow here.") == set()


def plain_stretches(m, words, least):
    """Best stretch of each template by looking at every gap between its word pairs."""
    out = []
    pairs = licenses.pairs_of(words).tolist()
    for t, (family, size) in enumerate(m.templates):
        own = [k for k, p in enumerate(pairs) if t in m.holders.get(p, ())]
        runs = []
        for k in own:
            if not runs or k - runs[-1][-1] > 10:
                runs.append([])
            runs[-1].append(k)
        best = max(((len({pairs[k] for k in r}), r[0], r[-1] + 2) for r in runs), default=(0, 0, 0))
        if best[0] and best[0] >= least * size:
            out.append((best[0] / size, best[0], family, best[1], best[2]))
    return sorted(out, key=lambda x: (-round(x[0], 2), -x[1], x[3], x[2]))


def plain_notices(m, text, least_probability, least_similarity):
    layout = licenses.lay_out(text, {})
    words, wins = np.array(layout.words, np.uint64), set()
    for marks in (layout.lines, layout.sentences):
        wins |= set(zip([0, *sorted(set(marks))], sorted(set(marks))))
    ends = sorted(set(layout.paragraphs))
    for a, b in zip([0, *ends], ends):
        for size, stride in licenses.WINDOWS:
            at = a
            while at == a or at < b - stride:
                wins.add((at, min(at + size, b)))
                at += stride
    known = set(m.vocabulary.tolist())
    grams = licenses.ngram_hashes(words)[1].tolist() if len(words) > 1 else []
    probability = lambda a, b: licenses._softmax(licenses.logits(m, words, np.array([a]), np.array([b])))[0]
    near = [(a, b) for a, b in sorted(wins) if b - a > 1 and any(g in known for g in grams[a : b - 1]) and probability(a, b)[0] < 0.5]
    inside = np.zeros(len(words) + 1, bool)
    regions = []
    for a, b in sorted((max(0, a - licenses.MARGIN), min(len(words), b + licenses.MARGIN)) for a, b in near):
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(b, regions[-1][1])
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        inside[:] = False
        for share, _, family, s, e in plain_stretches(m, words[a:b], least_similarity):
            if inside[s:e].any():
                continue
            part = licenses._softmax(licenses.logits(m, words[a:b], np.array([s]), np.array([e])))[0]
            if part.argmax() == family and part[family] >= least_probability:
                inside[s:e] = True
                out.append((0, a + s, e - s, m.families[family], pytest.approx(float(part[family])), pytest.approx(share)))
    return sorted(out, key=lambda x: x[1])


def test_notices_equal_a_plain_scan(scanner):
    rng = np.random.default_rng(2)
    texts = ["", "one", "\n\n", *(t for _, t in MENTIONS)]
    for _ in range(60):
        parts = [licenses.TEMPLATES[int(k)][1] for k in rng.integers(0, len(licenses.TEMPLATES), int(rng.integers(1, 4)))]
        words = " ".join(parts).split()
        kept = [w if rng.random() > 0.1 else "changed" for w in words]
        cut = int(rng.integers(0, len(kept)))
        texts.append(" ".join(kept[:cut]) + str(rng.choice(["\n", "\n\n", ". ", " "])) + sentence("aa", int(rng.integers(0, 90))) + " " + " ".join(kept[cut:]))
    found = 0
    for text in texts:
        got = licenses.classify(scanner, [text], {}, 0.5, 0.6)
        assert got == plain_notices(scanner, text, 0.5, 0.6)
        found += len(got)
    assert found > 60
    together = licenses.classify(scanner, texts, {}, 0.5, 0.6)
    assert [(f, n) for _, _, n, f, _, _ in together] == [(f, n) for t in texts for _, _, n, f, _, _ in licenses.classify(scanner, [t], {}, 0.5, 0.6)]
