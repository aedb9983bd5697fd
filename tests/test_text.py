"""Text, evidence, puzzle, calendar and source fixtures."""

import datetime
import itertools
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from threadloom.functions.words import title_words, tokens
from threadloom.operators import evidence, texts, views
from threadloom.plans import cross
from threadloom.sources import corpus, graphs, pages


def docs(spark, **texts_by_id):
    return spark.createDataFrame(list(texts_by_id.items()), "id string, text string")


def counts(spark, **bags):
    return spark.createDataFrame([(d, w, n) for d, bag in bags.items() for w, n in bag.items()], "id string, word string, tf long")


def test_tokens(spark):
    got = spark.createDataFrame([("A character’s red-blue costume, created in 1995; d'Été",)], "t string").select(tokens(F.col("t"))).first()[0]
    assert got == ["a", "character's", "red", "blue", "costume", "created", "in", "d'été"]


def test_shared_runs(spark):
    run = "one two three four five six seven eight nine"
    d = docs(spark, a=f"start {run} end", b=f"{run} other", c="one two three four five\n\nsix seven eight nine")
    got = {(r.a, r.b): r.length for r in texts.shared_runs(texts.paragraphs(d), 4).collect()}
    assert got == {("a", "b"): 9, ("a", "c"): 5, ("b", "c"): 5}
    tie = texts.shared_runs(texts.paragraphs(docs(spark, a="red blue green\n\nred blue green", b="red blue green")), 3).first()
    assert (tie.length, tie.para_a, tie.pos_a, tie.para_b, tie.pos_b) == (3, 0, 0, 0, 0)
    curve = {r.least: r for r in texts.threshold_curve(texts.shared_runs(texts.paragraphs(d), 4), d, 4, 10).collect()}
    assert (curve[5].pairs, curve[5].documents, curve[6].pairs, curve[6].documents, curve[10].pairs) == (3, 3, 1, 2, 0) and curve[5].percent == 100


def test_tfidf_closed_form(spark):
    d = docs(spark, a="", b="", c="")
    c = counts(spark, a={"common": 2, "amber": 2, "blue": 1}, b={"common": 1, "blue": 2}, c={"common": 1, "green": 1})
    vectors = texts.tfidf(c, d)
    w = {(r.id, r.word): r.w for r in vectors.collect()}
    norm = math.hypot(2 * math.log(3), math.log(1.5))
    assert ("a", "common") not in w and w["a", "amber"] == pytest.approx(2 * math.log(3) / norm)
    scores = {(r.a, r.b): r.score for r in texts.pair_scores(vectors).collect()}
    assert scores == {("a", "b"): pytest.approx(math.log(1.5) / norm)}
    near = {r.id: r.neighbor for r in texts.nearest(d, texts.pair_scores(vectors)).collect()}
    assert near == {"a": "b", "b": "a", "c": "a"}
    zero = texts.tfidf(counts(spark, a={"common": 3}, b={"common": 1}), docs(spark, a="", b=""))
    assert zero.count() == 0


def test_ties_between_equal_texts(spark):
    d = docs(spark, Alex="same words", Beth="same words", Charlie="same words")
    c = texts.term_counts(texts.words(d))
    near = {r.id: r.neighbor for r in texts.nearest(d, texts.pair_scores(texts.tfidf(c, d))).collect()}
    assert near == {"Alex": "Beth", "Beth": "Alex", "Charlie": "Alex"}


def test_title_mask_and_ablation(spark):
    ids = spark.createDataFrame([(i,) for i in ("Storm", "Human_Torch_(Johnny_Storm)", "Doctor_Strange_(Marvel_Comics)", "The_Thing_(comics)")], "id string")
    mask = {r.word for r in texts.title_mask(ids).collect()}
    assert mask == {"storm", "human", "torch", "doctor", "strange", "thing"}
    got = docs(spark, x="Storm's STORM storm’s fire-resistant 2099").select(F.explode(tokens(F.col("text"))).alias("word"))
    words = texts.words(docs(spark, x="Storm's STORM storm’s fire-resistant 2099"), possessives=False)
    assert {r.word: r.tf for r in texts.term_counts(words).collect()} == {"storm": 3, "fire": 1, "resistant": 1} and got.count() == 5
    d = docs(spark, Storm="storm torch torch torch rain cloud", Human_Torch="torch torch torch fire", Thor="rain cloud hammer")
    report = {r.id: r for r in texts.ablation(d, texts.term_counts(texts.words(d)), texts.title_mask(d.select("id"))).collect()}
    storm = report["Storm"]
    assert (storm.before, storm.after, storm.changed, storm.removed) == ("Human_Torch", "Thor", True, 4) and storm.same_pair_after == 0
    assert spark.range(1).select(title_words(F.lit("A%2BB+c_of_Things"))).first()[0] == ["things"]


def test_spearman_and_top_terms(spark):
    t = spark.createDataFrame([(1, 10, 1), (2, 20, 2), (3, 20, 3), (4, 30, 4)], "id int, x int, y int")
    ranked = {r.id: r.r for r in texts.average_ranks(t, "x", "r").collect()}
    assert ranked == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0}
    assert texts.spearman(t, "x", "y").first()[0] == pytest.approx(0.9486832981)
    assert texts.spearman(t.withColumn("y", F.lit(1)), "x", "y").first()[0] == 0
    v = spark.createDataFrame([("a", "u", 0.8), ("a", "v", 0.6), ("b", "u", 0.8), ("b", "v", 0.6)], "id string, word string, w double")
    got = texts.top_terms(spark.createDataFrame([("a", "b")], "id string, neighbor string"), v, 1).first()
    assert (got.word, round(got.product, 9), got.share) == ("u", 0.64, 0.64)


def test_sections_and_categories(spark):
    d = docs(spark, a="intro\nReception\nmore\n\nbody\n\nTelevision", b=None)
    got = {(r.id, r.para): r.section for r in texts.section_labels(d, ["Reception", "Television"]).collect()}
    assert got == {("a", 0): "Reception", ("a", 1): "Reception", ("a", 2): "Television", ("b", 0): "Lead"}
    runs = spark.createDataFrame([("a", "b", 9, 0, 0), ("a", "c", 9, 1, 0)], "a string, b string, length int, para_a int, para_b int")
    rules = spark.createDataFrame([("a", "c", "story")], "a string, b string, category string")
    assert {(r.b, r.category) for r in texts.pair_category(runs, rules, "lead").collect()} == {("b", "lead"), ("c", "story")}
    with pytest.raises(Exception, match="not reviewed"):
        texts.pair_category(runs, rules.limit(0), "lead").collect()


def test_offsets_and_excerpts(spark):
    text = "First words here.\n\n \nThe Storm’s café, and storm again."
    spans = evidence.word_spans(docs(spark, a=text, b=None)).collect()
    assert all(text[r.start : r.end].lower().replace("’", "'") == r.word for r in spans)
    assert [(r.para, r.pos) for r in spans][-1] == (1, 5)
    long = "lead in. " * 100 + "needle " + "tail end. " * 100
    e = evidence.term_excerpts(docs(spark, a=long).withColumn("term", F.lit("needle"))).first()
    assert e.excerpt == long[e.start : e.end] and "needle" in e.excerpt and len(e.excerpt) <= 360 and not e.excerpt.startswith(" ")
    hit = texts.literal_excerpts(docs(spark, a="abc needle def", b="none"), "needle", 3).collect()
    assert [tuple(r) for r in hit] == [("a", 4, 10, "bc ", " de")]
    short = "above\n\nA b needle's c.\n\nbelow needle"
    e = evidence.term_excerpts(docs(spark, a=short).withColumn("term", F.lit("needle"))).first()
    assert (e.start, e.end, e.excerpt, e.before, e.after) == (7, 22, "A b needle's c.", "above\n\n", "\n\nbelow needle")
    solid = "x" * 500 + " needle " + "y" * 500
    e = evidence.term_excerpts(docs(spark, a=solid).withColumn("term", F.lit("needle"))).first()
    assert (e.start, e.excerpt) == (501, "needle") and e.before == "x" * 79 + " "
    joined = "é" * 300 + "’needle " + "z" * 400
    with pytest.raises(Exception, match="lacks the term"):
        evidence.term_excerpts(docs(spark, a=joined).withColumn("term", F.lit("needle"))).collect()
    with pytest.raises(Exception, match="lacks the term"):
        evidence.term_excerpts(docs(spark, a="x").withColumn("term", F.lit("y"))).collect()


def test_lexical_against_distance(spark):
    n = docs(spark, A="", B="", C="").select("id")
    near = spark.createDataFrame([("A", "B", 0.0), ("B", "A", 0.0), ("C", "A", 0.0)], "id string, neighbor string, score double")
    dist = spark.createDataFrame([("A", "B", 1), ("B", "A", 1)] + [(x, x, 0) for x in "ABC"], "src string, node string, dist int")
    got = {r.bucket: (r.nearest, r.all_pairs) for r in cross.nearest_by_distance(n, near, dist).collect()}
    assert got == {"1": (2, 2), "2": (0, 0), "3": (0, 0), "4+": (0, 0), "disconnected": (1, 4)}


def test_names_and_search(spark):
    rows = [("s1", "Storm (comics)", 3), ("s2", "Storm (character)", 9), ("h", "Hulk (comics)", 5), ("x", "Hulkling", 1)]
    n = spark.createDataFrame(rows, "id string, name string, in_degree int")
    assert {r.id: r.display for r in views.display_names(n).collect()} == {"s1": "Storm (comics)", "s2": "Storm (character)", "h": "Hulk", "x": "Hulkling"}
    terms = spark.createDataFrame([(t,) for t in ("S1", "storm", "hulk", "none", "")], "term string")
    assert {r.term: r.id for r in views.search(n, terms).collect()} == {"S1": "s1", "storm": "s2", "hulk": "h"}
    assert {r.term: r.id for r in views.resolve(n, terms).collect()} == {"S1": "s1", "storm": None, "hulk": "h", "none": None, "": None}
    assert {r.term: (r.matches, r.id) for r in views.substring_resolve(n, terms).collect()}["hulk"] == (2, None)


def test_vectors(spark):
    starts = spark.createDataFrame([(1, 0.0, 99.0, 0.0), (2, 1.0, 1.0, 1.0)], "id long, x double, y double, z double")
    steps = spark.createDataFrame([(1, 2, -1.0, 1.0, 0.0, 5.0, 0.25), (1, 1, 1.0, 2.0, 0.123, 5.0, 0.0)], "id long, place long, sign double, weight double, dx double, dy double, dz double")
    got = {r.id: (r.x, r.y, r.z) for r in views.walk(starts, steps).collect()}
    assert got == {1: (0.2, 95.0, -0.2), 2: (1.0, 1.0, 1.0)}
    one = spark.range(4).select(views.stars(F.col("id"), F.lit(1)).alias("s"), views.board_stars(F.col("id")).alias("b"))
    assert [(r.s, r.b) for r in one.collect()] == [(3, 3), (3, 2), (2, 2), (2, 1)]


def test_puzzles(spark):
    wires = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "b", "c")], "board int, a string, b string")
    targets = spark.createDataFrame([(1, x, 1, 1) for x in "abc"], "board int, id string, in_target int, out_target int")
    assert views.orientation_counts(wires, targets).first().solutions == 2
    many = [(2, f"s{k:02}", f"s{(k + 1) % 31:02}") for k in range(31)] + [(3, "p", "q"), (3, "q", "r"), (4, "p", "q")]
    wanted = [(2, f"s{k:02}", 1, 1) for k in range(31)] + [(3, "p", 1, 0), (3, "q", 0, 2), (3, "r", 1, 0), (4, "p", 1, 0), (4, "q", 1, 0), (5, "lone", 0, 0)]
    found = views.orientation_counts(wires.union(spark.createDataFrame(many, wires.schema)), targets.union(spark.createDataFrame(wanted, targets.schema)))
    assert {r.board: r.solutions for r in found.collect()} == {1: 2, 2: 2, 3: 1, 4: 0}
    arrows = spark.createDataFrame([(1, "a", "b")], "board int, src string, dst string")
    assert {r.id: (r.incoming, r.outgoing, r.fits) for r in views.board_check(targets, arrows).collect()} == {"a": (0, 1, False), "b": (1, 0, False), "c": (0, 0, False)}
    plan = [(1, 1, "a", "b", "a", "b", "b"), (1, 2, "a", "c", "c", "a", None), (1, 3, "b", "c", "b", "c", None)]
    schema = "board int, place int, a string, b string, source string, target string, pointed string"
    assert views.board_hint(spark.createDataFrame(plan, schema), targets).first().kind == 2
    wrong = [(*plan[0][:6], "a"), *plan[1:]]
    assert tuple(views.board_hint(spark.createDataFrame(wrong, schema), targets).first())[1:3] == (1, 1)


def test_calendar(spark):
    at = {r.day: r.release_utc for r in views.release_calendar(spark, datetime.date(2026, 10, 21), 24).select("day", F.date_format("release_utc", "HH:mm").alias("release_utc")).collect()}
    got = [at[datetime.date(*d)] for d in ((2026, 10, 21), (2026, 10, 28), (2027, 3, 24), (2027, 3, 31))]
    assert got == ["17:00", "18:00", "18:00", "17:00"]
    for args in ((datetime.date(2026, 9, 10), 1), (datetime.date(2026, 9, 9), 0), (datetime.date(2026, 9, 9), 1, 24)):
        with pytest.raises(ValueError):
            views.release_calendar(spark, *args)
    due = views.released(views.release_calendar(spark, datetime.date(2026, 9, 9), 3), datetime.datetime(2026, 9, 20))
    assert [(r.week, r.latest) for r in due.orderBy("week").collect()] == [(1, False), (2, True)]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_loading(spark, tmp_path):
    good = write(tmp_path / "nodes.tsv", "﻿# roster\nnode_id\tname\turl\n\nA\tAnn\tu\nB\tBob\tv\n")
    n = graphs.load_nodes(spark, good)
    assert {(r.id, r.name, r.url) for r in n.collect()} == {("A", "Ann", "u"), ("B", "Bob", "v")}
    e = graphs.load_edges(spark, write(tmp_path / "edges.tsv", "source\ttarget\nA\tB\nB\tB\n"), n)
    assert {(r.src, r.dst, r.weight) for r in e.collect()} == {("A", "B", 1.0), ("B", "B", 1.0)}
    bad_nodes = {"head": "id\tname\nA\tx\n", "width": "node_id\tname\nA\n", "empty": "node_id\tname\n", "blank": "node_id\tname\nA\t\n", "twice": "node_id\tname\nA\tx\nA\ty\n"}
    for name, text in bad_nodes.items():
        with pytest.raises(ValueError):
            graphs.load_nodes(spark, write(tmp_path / f"{name}.tsv", text))
    for name, text in {"strange": "A\tZ\n", "again": "A\tB\nA\tB\n", "wide": "A\tB\t1\t2\n"}.items():
        with pytest.raises(ValueError):
            graphs.load_edges(spark, write(tmp_path / f"{name}.tsv", text), n)
    with pytest.raises(Exception):
        graphs.load_nodes(spark, str(tmp_path / "missing.tsv"))
    lax = graphs.load_edges(spark, write(tmp_path / "weights.tsv", "A\tZ\t2.5\n"), n, strict=False)
    assert lax.first().weight == 2.5


def test_corpora(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("README.txt", "skip")
        z.writestr("texts/Name%3A_title.txt", "﻿body")
    got = corpus.load_zip(spark, str(tmp_path / "c.zip"))
    assert [tuple(r) for r in got.collect()] == [("Name:_title", "body")]
    with pytest.raises(ValueError, match="missing"):
        corpus.check_corpus(got, spark.createDataFrame([("Name:_title",), ("Other",)], "id string"))
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "A%3Ab.txt", "x\ny")
    assert [tuple(r) for r in corpus.load_folder(spark, str(tmp_path / "d")).collect()] == [("A:b", "x\ny")]


def test_snapshots_bundles_and_hashes(spark, tmp_path):
    page = '{"category": "c", "pages": [{"title": "A", "url": "u", "links": ["B", "A", "Z", "B"]}, {"title": "B", "url": "v", "links": []}]}'
    n, e = graphs.load_snapshot(spark, write(tmp_path / "s.json", page))
    assert n.count() == 2 and [tuple(r) for r in e.collect()] == [("A", "B")]
    assert graphs.load_bundle(spark, write(tmp_path / "b.js", f"window.DATA = {page};\n")).first().category == "c"
    assert graphs.provenance(spark, str(tmp_path / "s.json")).first().bytes == len(page)
    graphs.write_json(e, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().src == "A"


def test_paginated_listing():
    answers = iter([OSError(), {"query": {"categorymembers": [{"ns": 0, "title": "A"}, {"ns": 1, "title": "Talk"}]}, "continue": {"cmcontinue": "x"}}, {"query": {"categorymembers": [{"ns": 0, "title": "List of B"}, {"ns": 0, "title": "C"}]}}])
    asked = []

    def get(url):
        import json

        asked.append(url)
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return json.dumps(answer)

    pages.time.sleep = lambda s: None
    assert list(pages.members("http://h/api", "Category:X", get=get)) == ["A", "C"] and "cmcontinue=x" in asked[-1]


def test_stream(spark, tmp_path):
    from threadloom.streaming import counts as stream

    rows = [(k, datetime.datetime(2026, 1, 1, k % 5, 30), k % 3, "click", 1.0, "") for k in range(50)]
    spark.createDataFrame(rows, stream.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(99, datetime.datetime(2026, 1, 2), 1, "click", 1.0, "")], stream.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream.run_available(stream.windowed_degrees(stream.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("events")).first()[0] == 50


def test_passages_are_the_runs(spark):
    run = "One two three, four five six seven"
    d = docs(spark, a=f"Start.\n\nSome {run} end.", b=f"{run.upper()} other")
    got = evidence.passages(d, texts.shared_runs(texts.paragraphs(d), 5), context=5).first()
    assert (got.a, got.b, got.passage, got.before, got.after) == ("a", "b", run, "Some ", " end.")


def test_every_pair_has_a_score_and_a_place(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["red blue", "red blue", "green", "blue green", None])], "id long, text string")
    scores = texts.pair_scores(texts.unit_bags(texts.term_counts(texts.words(docs))))
    every = texts.all_pair_scores(docs, scores)
    got = {(r.a, r.b): r.score for r in every.collect()}
    assert len(got) == 10 and got[0, 2] == 0 and got[0, 4] == 0 and abs(got[0, 1] - 1) < 1e-12
    dist = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (0, 3, 2)], "src long, node long, dist int")
    pairs = cross.pair_distances(docs, scores, dist)
    lone = cross.top_placed(pairs, pairs.where("dist IS NULL"), 2).collect()
    order = sorted((-round(s, 9), a, b) for (a, b), s in got.items())
    assert {(r.a, r.b, r.place) for r in lone} == {(a, b, k) for k, (_, a, b) in enumerate(order, 1) if (a, b) in [(r.a, r.b) for r in lone]}
    assert len(lone) == 2 and all(r.dist is None for r in lone)


def test_medians_of_an_ablation(spark):
    rows = [(1, 0.5, 0.25, True, 3), (2, 0.9, 0.9, False, 1), (3, 0.1, 0.0, True, 0)]
    report = spark.createDataFrame(rows, "id long, before_score double, same_pair_after double, changed boolean, removed long")
    assert tuple(texts.ablation_summary(report).first()) == (2, 1, 4, 0.5, 0.25)


def longest_runs(docs, least):
    """Longest common run of every two documents by comparing all positions."""
    out = {}
    for a, b in itertools.combinations(sorted(docs), 2):
        found = []
        for (pa, x), (pb, y) in itertools.product(enumerate(docs[a]), enumerate(docs[b])):
            for i, j in itertools.product(range(len(x)), range(len(y))):
                if x[i] == y[j] and not (i and j and x[i - 1] == y[j - 1]):
                    n = next((k for k in range(min(len(x) - i, len(y) - j)) if x[i + k] != y[j + k]), min(len(x) - i, len(y) - j))
                    if n >= least:
                        found.append((-n, pa, i, pb, j))
        if found:
            n, *rest = min(found)
            out[a, b] = (-n, *rest)
    return out


@pytest.mark.parametrize("most", [3, 2048])
def test_runs_of_repeated_wording(spark, most):
    import numpy as np

    rng = np.random.default_rng(most)
    stock = [[str(w) for w in rng.choice(["ka", "lo", "mi", "nu"], int(rng.integers(2, 9)))] for _ in range(7)]
    docs = {}
    for k in range(24):
        docs[k] = [list(stock[int(n)]) for n in rng.integers(0, 7, int(rng.integers(1, 4)))]
        for p in docs[k]:
            if rng.random() < 0.3:
                p[int(rng.integers(len(p)))] = "xe"
    table = spark.createDataFrame([(k, "\n\n".join(" ".join(p) for p in ps)) for k, ps in docs.items()] + [(90, None), (91, "")], "id long, text string")
    got = texts.shared_runs(texts.paragraphs(table), 3, most)
    assert {(r.a, r.b): tuple(r)[2:] for r in got.collect()} == longest_runs(docs, 3)


def test_scores_of_frequent_terms(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(k, f"w{j}", float(rng.random())) for k in range(40) for j in range(6) if rng.random() < 0.7]
    want = {}
    for (a, w, x), (b, v, y) in itertools.product(rows, rows):
        if a < b and w == v:
            want[a, b] = want.get((a, b), 0) + x * y
    table = spark.createDataFrame(rows, "id long, word string, w double")
    for most in (4, 2048):
        assert {(r.a, r.b): r.score for r in texts.pair_scores(table, most).collect()} == pytest.approx(want)
