"""The pipeline: planted documents, a plain version of every decision, and the stages' contracts."""

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from threadloom.llm import simhash  # noqa: E402
from threadloom.session import materialize  # noqa: E402

RNG = np.random.default_rng(11)
WORDS = {"en": ["".join(RNG.choice(["tho", "ing", "er", "wh", "an"], 3)) for _ in range(300)], "de": ["".join(RNG.choice(["sch", "ung", "ei", "pf", "ü"], 3)) for _ in range(300)]}


def prose(lang, n=120):
    return " ".join(RNG.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    item = prose("en", 30)
    rows = [(i, prose("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(200)]
    labels = []
    for i in range(200, 300):
        rows.append((i, f"{prose('en', 40)} villain villain {prose('en', 40)}", "en"))
        labels.append((i, 1))
    labels += [(i, 0) for i in range(200)]
    base = rows[7][1].split()
    near = [w if k not in (30, 90) else "edited" for k, w in enumerate(base)]
    rows += [(400, rows[7][1], "en"), (401, " ".join(near), "en"), (402, "123 !!", "en"), (403, None, None), (404, f"{prose('de', 50)} {item} {prose('de', 50)}", "de"), (405, "", "de"), (5, rows[5][1], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 AS quality").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_every_decision_takes_effect(spark, tables):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, tables).collect()}
    assert set(got) == set(range(200))
    from sentencepiece import SentencePieceProcessor

    import public_tokenizers

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert all(list(r.ids) == library.encode(texts[i]) and r.exact for i, r in got.items())


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "near_copies", "decontamination", "encoding"]
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, _ = materialize(stage(spark, docs, tables), "test-stage")
        assert after.columns == docs.columns
        gone[name] = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()}
        docs = after
    assert gone == {"language": {402, 403, 405}, "toxicity": set(range(200, 300)), "near_copies": {400, 401}, "decontamination": {404}}


def test_groups_hold_all_similar_texts(spark):
    texts = [prose("en", int(n)) for n in RNG.integers(60, 400, 30)]
    rows = [(k, t) for k, t in enumerate(texts)]
    for k, t in enumerate(texts):
        words = t.split()
        for copy in range(3):
            own = list(words)
            for at in RNG.integers(0, len(own), max(1, len(own) // 90)):
                own[at] = f"x{copy}y{at}"
            rows.append((1000 + 3 * k + copy, " ".join(own)))
    shared = prose("de", 60)
    rows += [(5000 + k, f"{shared} {prose('en', 200)}") for k in range(40)]
    sets = {i: frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    found = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    similar = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(similar) > 60
    assert np.mean([found[a] == found[b] for a, b in similar]) >= 0.97
    assert all(found[i] == i for i in range(5000, 5040))
    assert all(found[1000 + 3 * k + c] in (k, 1000 + 3 * k, 1000 + 3 * k + 1, 1000 + 3 * k + 2) for k in range(30) for c in range(3))


def test_near_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(empty).collect() == []
    alike = spark.createDataFrame([(3, None), (2, ""), (1, " \t"), (4, "word")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_groups(alike).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def edited(count, sizes, edit):
    """Random texts, each with an edited copy, and the shingle sets of all."""
    rng, rows = np.random.default_rng(5), []
    for k in range(count):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.choice(sizes)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edit(words, rng)))]
    return rows, {i: frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}


def pairs_at_least(sets, least, most=2.0):
    out = []
    for k in range(0, len(sets), 2):
        alike = len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1])
        out += [k] if least <= alike < most else []
    return out


def test_short_similar_texts_are_all_found(spark):
    def edit(words, rng):
        out = list(words)
        if len(out) >= 49:
            out[int(rng.integers(4, len(out) - 4))] = "other"
        else:
            out += ["more"] * int(rng.integers(1, 1 + max(1, len(out) // 10)))
        return out

    rows, sets = edited(400, [6, 8, 12, 20, 30, 49, 60, 94, 100], edit)
    found = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    similar = pairs_at_least(sets, 0.8)
    assert len(similar) > 300
    assert all(found[k + 1] == k for k in similar)


def test_texts_below_the_similarity_stay_apart(spark):
    def edit(words, rng):
        out = list(words)
        for at in np.linspace(10, len(out) - 10, len(out) * 7 // 240).astype(int):
            out[at] = f"other{at}"
        return out

    rows, sets = edited(200, [240, 480, 1000], edit)
    found = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: simhash.simhash64(t.encode(), 5) for i, t in rows}
    unlike = [k for k in pairs_at_least(sets, 0.6, 0.8) if (prints[k] ^ prints[k + 1]).bit_count() > 4]
    assert len(unlike) > 150
    assert all(found[k + 1] == k + 1 for k in unlike)
