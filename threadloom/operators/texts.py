"""Shared wording and lexical similarity over ``docs(id, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.words import LETTER, STOPWORDS, title_words, tokens, without_possessive
from threadloom.operators import tiles
from threadloom.operators.components import with_found, with_value
from threadloom.operators.units import met_pairs
from threadloom.session import drop_path, materialize

BLANK_LINE = r"\n\s*\n"


def paragraphs(docs: DataFrame, separator: str = BLANK_LINE, unit: str = LETTER) -> DataFrame:
    """``(id, para, words)``: paragraphs that hold a word, numbered from 0."""
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), separator), lambda p: tokens(p, unit))
    return docs.select("id", F.posexplode(F.filter(parts, lambda w: F.size(w) > 0)).alias("para", "words"))


def words(docs: DataFrame, unit: str = LETTER, possessives: bool = True) -> DataFrame:
    """``(id, word)``, one row per token; ``possessives=False`` strips a final 's."""
    w = docs.select("id", F.explode(tokens(F.coalesce("text", F.lit("")), unit)).alias("word"))
    return w if possessives else w.select("id", without_possessive(F.col("word")).alias("word"))


def term_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "word").agg(F.count("*").alias("tf"))


def token_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, tokens, types, and the smallest and largest document (ids ascending among ties)."""
    size = F.size(tokens(F.coalesce("text", F.lit(""))))
    sized = docs.select("id", size.alias("n"))
    types = words(docs).agg(F.countDistinct("word").alias("types"))
    low, high = F.min(F.struct("n", "id")), F.min(F.struct((-F.col("n")).alias("n"), F.col("id").alias("id")))
    out = sized.agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("tokens"), low.alias("low"), high.alias("high")).crossJoin(types)
    return out.select("documents", "tokens", "types", F.col("low.id").alias("smallest_id"), F.col("low.n").alias("smallest"), F.col("high.id").alias("largest_id"), (-F.col("high.n")).alias("largest"))


def ngrams(paras: DataFrame, n: int) -> DataFrame:
    """``(id, para, pos, gram)``: every run of ``n`` words inside a paragraph."""
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
    return paras.where(F.size("words") >= n).select("id", "para", F.posexplode(grams).alias("pos", "gram"))


def gram_hashes(paras: DataFrame, n: int) -> DataFrame:
    """``(id, para, pos, h, g)``: every run of ``n`` words inside a paragraph as two 64-bit hashes."""
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))
    each = F.transform(runs, lambda run: F.struct(F.xxhash64(run).alias("h"), F.xxhash64(F.lit(1), run).alias("g")))
    return paras.where(F.size("words") >= n).select("id", "para", F.posexplode(each).alias("pos", "x")).select("id", "para", "pos", "x.h", "x.g")


def seed_stretches(paras: DataFrame, n: int) -> DataFrame:
    """``(id, para, pos, times, h, g)``: the rows of :func:`gram_hashes` where equal ones that follow each other, one word over and over, are one row."""
    same = lambda i: F.get("words", i - 2).eqNullSafe(F.get("words", i - 1)) & (F.size(F.array_distinct(F.slice("words", i - 1, n + 1))) == 1)
    starts = F.filter(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: (i == 1) | ~same(i))
    held = paras.where(F.size("words") >= n).select("id", "para", "words", starts.alias("starts"))
    run = lambda i: F.slice("words", i, n)
    upto = lambda j: F.coalesce(F.get("starts", j + 1), F.size("words") - n + 2)
    each = F.transform("starts", lambda i, j: F.struct((i - 1).alias("pos"), (upto(j) - i).alias("times"), F.xxhash64(run(i)).alias("h"), F.xxhash64(F.lit(1), run(i)).alias("g")))
    return held.select("id", "para", F.explode(each).alias("x")).select("id", "para", "x.*")


def ngram_documents(paras: DataFrame, n: int, k: int) -> DataFrame:
    """The ``k`` runs found in most documents, ties by wording: ``(gram, documents, pairs)``.

    Runs are counted by their hashes; only those with at least the k-th largest count get their wording back. They are written
    first, so that few are broadcast and many are not. A run's documents meet by its hashes alone, so one shuffle does, and
    runs of one document, nearly all, are only written where fewer than ``k`` have two.
    """
    each = gram_hashes(paras, n).select("h", "g", "id").repartition("h", "g").distinct().groupBy("h", "g").agg(F.count("*").alias("documents"))
    counts, path = materialize(each.where("documents > 1"), "grams")
    if counts.count() < k:
        drop_path(paras.sparkSession, path)
        counts, _ = materialize(each, "grams")
    least = counts.select("documents").orderBy(F.desc("documents")).limit(k).agg(F.min("documents").alias("least"))
    top, _ = materialize(counts.crossJoin(F.broadcast(least)).where("documents >= least").drop("least"), "top-grams")
    met = gram_hashes(paras, n).join(top, ["h", "g"]).select("id", "para", "pos", "h", "g", "documents").groupBy("h", "g").agg(F.first("documents").alias("documents"), F.min(F.struct("id", "para", "pos")).alias("at"))
    worded = met.select(F.col("at.id").alias("id"), F.col("at.para").alias("para"), F.col("at.pos").alias("pos"), "documents").join(paras, ["id", "para"])
    by = worded.select(F.array_join(F.slice("words", F.col("pos") + 1, n), " ").alias("gram"), "documents")
    return by.orderBy(F.desc("documents"), "gram").limit(k).select("gram", "documents", F.floor(F.col("documents") * (F.col("documents") - 1) / 2).cast("long").alias("pairs"))


def phrase_presence(paras: DataFrame, phrases: DataFrame, n: int) -> DataFrame:
    """``phrases(gram)`` -> ``(gram, lead_docs, body_docs)``: documents that hold it in paragraph 0, and in a later one."""
    met = ngrams(paras, n).join(F.broadcast(phrases), "gram").select("gram", "id", (F.col("para") == 0).alias("lead")).distinct()
    return met.groupBy("gram").agg(F.count(F.when(F.col("lead"), 1)).alias("lead_docs"), F.count(F.when(~F.col("lead"), 1)).alias("body_docs"))


def _expanded(runs: DataFrame, places: DataFrame, key: str, names: tuple[str, str], most: int = 2048) -> DataFrame:
    """``runs`` with every ``(id, para)`` of ``places(k, id, para, parts)`` that holds the paragraph ``key``; places of a hot one are dealt into parts."""
    parts = runs.select(F.col(key).alias("k")).groupBy("k").agg(F.count("*").alias("_rows")).join(places.groupBy("k").agg(F.max("parts").alias("parts")), "k")
    keyed = with_found(runs.withColumn("k", F.col(key)), parts, "k", "parts")
    dealt = keyed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    held = places.select("k", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias(names[0]), F.col("para").alias(names[1]))
    return dealt.join(held, ["k", "part"]).drop("k", "part")


def shared_runs(paras: DataFrame, least: int = 8, most: int = 2048) -> DataFrame:
    """``(a, b, length, para_a, pos_a, para_b, pos_b)``: the longest common run of each document pair with one of ``least`` words.

    Equal paragraphs count as one until the end. Seeds of ``least`` words meet on their two 64-bit hashes, hot ones in
    units of ``most`` rows; seeds that follow each other on one diagonal are one run. Ties go to the earliest position in a, then in b.

    A word over and over meets as one stretch, on the two diagonals that align the stretches' starts or ends. On any other, the
    run ends with the stretches on both sides, so it is no longer than the one from both starts, and begins no earlier.
    """
    long = paras.where(F.size("words") >= least).select("id", "para", "words", F.struct(F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("g")).alias("k"))
    long, path = materialize(long, "paragraphs")
    distinct, _ = materialize(long.groupBy("k").agg(F.first("words").alias("words")).withColumn("p", F.monotonically_increasing_id()), "distinct")
    firsts = long.groupBy("k", "id").agg(F.min("para").alias("para"), F.first(F.size("words")).alias("n")).join(distinct.select("k", "p"), "k").select(F.col("p").alias("k"), "id", "para", "n")
    places, _ = materialize(with_value(firsts, "k", F.ceil(F.count("*") / most).cast("int"), "parts"), "places")
    drop_path(paras.sparkSession, path)
    seeds, path = materialize(seed_stretches(distinct.select(F.col("p").alias("id"), F.lit(0).alias("para"), "words"), least).select(F.col("id").alias("k"), "pos", "times", "h", "g"), "seeds")
    common = seeds.groupBy("h").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("_rows")).where("low <> high")
    kept, _ = materialize(with_found(seeds, common.select("h", F.lit(True).alias("common"), "_rows"), "h", "common").where("common").drop("common"), "common")
    drop_path(paras.sparkSession, path)
    both_times = F.least("x.times", "y.times")
    at = lambda *more: F.struct(*((F.col(f"{c}.pos") + m).alias(f"pos_{n}") for c, n, m in zip("xy", "pq", more)), both_times.alias("times"))
    starts, ends = at(F.lit(0), F.lit(0)), at(F.col("x.times") - both_times, F.col("y.times") - both_times)
    aligned = F.when(F.col("x.times") == F.col("y.times"), F.array(starts)).otherwise(F.array(starts, ends))
    met = met_pairs(kept, "h", "k", most).where("x.g = y.g").select(F.col("x.k").alias("p"), F.col("y.k").alias("q"), F.explode(aligned).alias("e")).select("p", "q", "e.*")
    met = met.repartition("p", "q").withColumn("diagonal", F.col("pos_p") - F.col("pos_q"))
    before = F.sum("times").over(Window.partitionBy("p", "q", "diagonal").orderBy("pos_p").rowsBetween(Window.unboundedPreceding, -1))
    island = F.col("pos_p") - F.coalesce(before, F.lit(0))
    runs = met.withColumn("island", island).groupBy("p", "q", "diagonal", "island").agg((F.sum("times") + least - 1).alias("length"), F.min("pos_p").alias("pos_p"), F.min("pos_q").alias("pos_q"))
    first = lambda x, y: F.min(F.struct((-F.col("length")).alias("l"), F.col(x).alias("pos_a"), F.col(y).alias("pos_b")))
    best, _ = materialize(runs.groupBy("p", "q").agg(first("pos_p", "pos_q").alias("pq"), first("pos_q", "pos_p").alias("qp")), "runs")
    both = best.select(F.explode(F.array(F.struct(F.col("p").alias("x"), F.col("q").alias("y"), F.col("pq").alias("r")), F.struct(F.col("q").alias("x"), F.col("p").alias("y"), F.col("qp").alias("r")))).alias("e")).select("e.x", "e.y", "e.r")
    spread = _expanded(_expanded(both, places, "x", ("a", "para_a")), places, "y", ("b", "para_b")).where("a < b")
    place = lambda para, pos: F.shiftleft(F.col(para).cast("long"), 32).bitwiseOR(pos)
    unequal = spread.select("a", "b", F.col("r.l").cast("long").alias("l"), place("para_a", F.col("r.pos_a")).alias("at_a"), place("para_b", F.col("r.pos_b")).alias("at_b"))
    same = met_pairs(places.select("k", "id", "para", "n"), "k", "id", most)
    equal = same.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), (-F.col("x.n")).cast("long").alias("l"), place("x.para", F.lit(0)).alias("at_a"), place("y.para", F.lit(0)).alias("at_b"))
    best = unequal.union(equal).repartition("a", "b").groupBy("a", "b").agg(F.min(F.struct("l", "at_a", "at_b")).alias("r"))
    ends = [x for c in "ab" for x in (F.shiftright(f"r.at_{c}", 32).cast("int").alias(f"para_{c}"), F.col(f"r.at_{c}").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias(f"pos_{c}"))]
    return best.select("a", "b", (-F.col("r.l")).alias("length"), *ends)


def sharing_pairs(paras: DataFrame, n: int, most: int = 2048) -> DataFrame:
    """One row ``(pairs)``: how many document pairs have a common run of ``n`` words or more, which is to share one of ``n`` words.

    Runs found in the same documents count as one, and so do documents that hold the same of these; both are told apart by
    two 64-bit sums of hashes. So only one document of each kind meets others, and a pair of kinds counts as many pairs as it stands for.
    """
    twice = lambda c: [F.bit_xor(F.xxhash64(c)).alias("u"), F.bit_xor(F.xxhash64(F.lit(1), c)).alias("v")]
    grams = gram_hashes(paras.where("id IS NOT NULL"), n).select("h", "g", "id").repartition("h", "g").distinct()
    each, path = materialize(grams.select(F.struct("h", "g").alias("gram"), "id"), "grams")
    spread = each.groupBy("gram").agg(F.count("*").alias("_rows"), *twice("id")).where("_rows > 1")
    lines, _ = materialize(spread.groupBy("_rows", "u", "v").agg(F.min("gram").alias("gram")).select("gram", F.lit(True).alias("kept"), "_rows"), "lines")
    held, _ = materialize(with_found(each, lines, "gram", "kept").where("kept").drop("kept"), "held")
    drop_path(paras.sparkSession, path)
    kinds, _ = materialize(held.groupBy("id").agg(F.count("*").alias("lines"), *twice("gram")).groupBy("lines", "u", "v").agg(F.min("id").alias("id"), F.count("*").alias("docs")), "kinds")
    met = met_pairs(held.join(kinds.select("id", "docs"), "id"), "gram", "id", most)
    across = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.docs") * F.col("y.docs")).alias("pairs")).distinct()
    within = kinds.select((F.col("docs") * (F.col("docs") - 1) / 2).cast("long").alias("pairs"))
    return across.select("pairs").union(within).agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"))


def longest_runs_of(pairs: DataFrame, paras: DataFrame, least: int = 8) -> DataFrame:
    """``pairs(a, b)`` -> ``(a, b, length)``: the longest common run of each of these document pairs with one of ``least`` words.

    Seeds meet inside the given pairs only. A document's equal paragraphs count once, and one that both hold is a run as it is.
    """
    key = F.struct(F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("g"))
    long = paras.where(F.size("words") >= least).select("id", key.alias("k"), "para", "words").groupBy("id", "k").agg(F.min("para").alias("para"), F.first("words").alias("words"))
    long, _ = materialize(long, "paragraphs")
    asked, _ = materialize(pairs.select("a", "b").distinct(), "asked")
    whole = lambda c: asked.join(long.select(F.col("id").alias(c), "k", F.size("words").cast("long").alias("length")), c)
    equal = whole("a").join(whole("b").select("a", "b", "k"), ["a", "b", "k"]).select("a", "b", "length")
    seeds, _ = materialize(gram_hashes(long, least).join(long.select("id", "para", "k"), ["id", "para"]), "seeds")
    end = lambda c: asked.join(seeds.select(F.col("id").alias(c), "h", "g", F.col("para").alias(f"para_{c}"), F.col("pos").alias(f"pos_{c}"), F.col("k").alias(f"k_{c}")), c)
    met = end("a").join(end("b"), ["a", "b", "h", "g"]).where("k_a <> k_b").withColumn("diagonal", F.col("pos_a") - F.col("pos_b"))
    line = ["a", "b", "para_a", "para_b", "diagonal"]
    island = F.col("pos_a") - F.row_number().over(Window.partitionBy(*line).orderBy("pos_a"))
    runs = met.withColumn("island", island).groupBy(*line, "island").agg((F.count("*") + least - 1).alias("length"))
    return runs.select("a", "b", "length").union(equal).groupBy("a", "b").agg(F.max("length").alias("length"))


def threshold_curve(runs: DataFrame, docs: DataFrame, low: int = 8, high: int = 60) -> DataFrame:
    """Per length from ``low`` to ``high``: pairs with a run that long, documents in them, and percent of all pairs."""
    spark = runs.sparkSession
    levels = F.broadcast(spark.range(low, high + 1).select(F.col("id").cast("int").alias("least")))
    n = docs.agg(F.count("*").alias("n"))
    longest, _ = materialize(runs.groupBy("a", "b").agg(F.max("length").alias("length")), "lengths")
    own = longest.select(F.explode(F.array("a", "b")).alias("id"), "length").groupBy("id").agg(F.max("length").alias("length"))

    def reaching(rows: DataFrame, name: str) -> DataFrame:
        """Rows of each level's length or more, from their counts by length; those over ``high`` count as ``high``."""
        counts = rows.groupBy(F.least("length", F.lit(high)).alias("length")).agg(F.count("*").alias("_n"))
        return levels.join(counts, F.col("length") >= F.col("least")).groupBy("least").agg(F.sum("_n").alias(name))

    pairs, ends = reaching(longest, "pairs"), reaching(own, "documents")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = levels.join(pairs, "least", "left").join(ends, "least", "left").crossJoin(n)
    return out.select("least", zero("pairs"), zero("documents"), F.coalesce(200 * F.col("pairs") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)), F.lit(0.0)).alias("percent"))


def section_labels(docs: DataFrame, headings: list[str], separator: str = BLANK_LINE) -> DataFrame:
    """``(id, para, section)``: the last line up to a paragraph's end that is a known heading; ``Lead`` before any."""
    known = F.array(*(F.lit(h) for h in headings))
    parts = docs.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), separator)).alias("para", "body"))
    lines = F.filter(F.transform(F.split("body", "\n"), F.trim), lambda x: F.array_contains(known, x))
    own = parts.select("id", "para", F.get(lines, F.size(lines) - 1).alias("heading"))
    upto = Window.partitionBy("id").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("id", "para", F.coalesce(F.last("heading", ignorenulls=True).over(upto), F.lit("Lead")).alias("section"))


def tfidf(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """``(id, word, w)``: raw counts times ln(N / df), terms of every document out, scaled to unit length."""
    n = docs.agg(F.count("*").alias("n"))
    df = counts.groupBy("word").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("word", F.ln(F.col("n") / F.col("df")).alias("idf")).where("idf > 0")
    raw = counts.join(idf, "word").select("id", "word", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "word", (F.col("w") / norm).alias("w"))


def unit_bags(counts: DataFrame, stoplist: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """``(id, word, w)``: raw counts without the stoplist, scaled to unit length."""
    kept = counts.where(~F.col("word").isin(*stoplist))
    norm = kept.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return kept.join(norm, "id").select("id", "word", (F.col("tf") / F.col("norm")).alias("w"))


def pair_scores(vectors: DataFrame, most: int = 2048) -> DataFrame:
    """``vectors(id, word, w)`` -> ``(a, b, score)`` with a < b: cosine of the pairs that share a term.

    A term's documents are cut into blocks of about ``most``, and every pair of blocks is multiplied by itself; products
    add up before they are shuffled.
    """
    met = met_pairs(vectors.select("word", "id", "w"), "word", "id", most)
    return met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("score"))


def all_pair_scores(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """``(a, b, score)`` of every unordered pair of documents, 0 where the two share no term; as large as its answer, n squared."""
    ids = docs.select("id").distinct()
    every = ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    return every.join(scores, ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"))


def nearest(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """``(id, neighbor, score)``: the best-scored other document, smallest id among ties; scores are compared at 9 places.

    A document without a shared term has score 0 with all others and takes the smallest other id.
    """
    both = scores.select(F.col("a").alias("id"), F.col("b").alias("neighbor"), "score").union(scores.select("b", "a", "score"))
    best = both.withColumn("score", F.round("score", 9)).where("score > 0").groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "neighbor")).alias("m"))
    return _or_first(docs, best)


def nearest_texts(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """:func:`nearest` from ``vectors(id, word, w)``: scores of blocks of documents are multiplied in tasks, and none is written."""
    best = tiles.best_others(docs, vectors)
    return _or_first(docs, best.select("id", F.struct((-F.col("score")).alias("s"), "neighbor").alias("m")))


def _or_first(docs: DataFrame, best: DataFrame) -> DataFrame:
    """``best(id, m)`` of all documents; those without one take the smallest other id."""
    two = docs.orderBy("id").limit(2).agg(F.min("id").alias("first"), F.max("id").alias("second"), F.count("*").alias("n"))
    other = F.when(F.col("n") > 1, F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    out = docs.select("id").join(best, "id", "left").crossJoin(F.broadcast(two))
    return out.select("id", F.coalesce(F.col("m.neighbor"), other).alias("neighbor"), F.coalesce(-F.col("m.s"), F.lit(0.0)).alias("score"))


def top_terms(pairs: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Per pair ``(id, neighbor)``: the ``k`` terms with the largest weight products, and their share of the score."""
    left = vectors.select("id", "word", F.col("w").alias("wa"))
    right = vectors.select(F.col("id").alias("neighbor"), "word", F.col("w").alias("wb"))
    met = pairs.select("id", "neighbor").join(left, "id").join(right, ["neighbor", "word"])
    product = met.select("id", "neighbor", "word", F.round(F.col("wa") * F.col("wb"), 9).alias("product"))
    w = Window.partitionBy("id", "neighbor")
    ranked = product.select("*", F.sum("product").over(w).alias("total"), F.row_number().over(w.orderBy(F.desc("product"), "word")).alias("place"))
    return ranked.where(F.col("place") <= k).select("id", "neighbor", "place", "word", "product", F.round(F.col("product") / F.nullif(F.col("total"), F.lit(0.0)), 6).alias("share"))


def average_ranks(table: DataFrame, measure: str, name: str) -> DataFrame:
    """Adds the mean 1-based place of each value among ties."""
    counts = table.groupBy(measure).agg(F.count("*").alias("_n"))
    upto = Window.orderBy(measure).rowsBetween(Window.unboundedPreceding, 0)
    places = counts.select(measure, (F.sum("_n").over(upto) - (F.col("_n") - 1) / 2).alias(name))
    return table.join(places, measure)


def spearman(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(spearman)``: Pearson's correlation of average ranks, 0 where a side doesn't vary."""
    both = average_ranks(average_ranks(table, x, "_rx"), y, "_ry")
    spread = F.sqrt(F.var_pop("_rx") * F.var_pop("_ry"))
    return both.agg(F.coalesce(F.covar_pop("_rx", "_ry") / F.nullif(spread, F.lit(0.0)), F.lit(0.0)).alias("spearman"))


def title_mask(ids: DataFrame) -> DataFrame:
    """Distinct title words of all ``ids(id)``."""
    return ids.select(F.explode(title_words(F.col("id"))).alias("word")).distinct()


def scores_of(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs(a, b)`` -> ``(a, b, score)`` of those that share a term; only their own terms meet."""
    end = lambda c: vectors.select(F.col("id").alias(c), "word", F.col("w").alias(f"w_{c}"))
    met = pairs.select("a", "b").distinct().join(end("a"), "a").join(end("b"), ["b", "word"])
    return met.groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("score"))


def ablation(docs: DataFrame, counts: DataFrame, mask: DataFrame) -> DataFrame:
    """Nearest neighbours before and after leaving the mask's words out everywhere.

    ``(id, before, before_score, after, after_score, changed, same_pair_after, removed, removed_share)``.
    """
    kept = counts.join(mask, "word", "left_anti")
    rest, _ = materialize(tfidf(kept, docs), "vectors")
    before, _ = materialize(nearest_texts(docs, materialize(tfidf(counts, docs), "vectors")[0]), "before")
    after = nearest_texts(docs, rest)
    after_scores = scores_of(before.where("neighbor IS NOT NULL").select(F.least("id", "neighbor").alias("a"), F.greatest("id", "neighbor").alias("b")), rest)
    sizes = counts.groupBy("id").agg(F.sum("tf").alias("all"))
    left = kept.groupBy("id").agg(F.sum("tf").alias("left"))
    pair = (F.least("id", "before") == F.col("a")) & (F.greatest("id", "before") == F.col("b"))
    out = before.select("id", F.col("neighbor").alias("before"), F.col("score").alias("before_score")).join(after.select("id", F.col("neighbor").alias("after"), F.col("score").alias("after_score")), "id")
    out = out.join(after_scores, pair, "left").join(sizes, "id", "left").join(left, "id", "left")
    removed = F.coalesce("all", F.lit(0)) - F.coalesce("left", F.lit(0))
    return out.select(
        "id", "before", "before_score", "after", "after_score", (F.col("before") != F.col("after")).alias("changed"),
        F.coalesce(F.round("score", 9), F.lit(0.0)).alias("same_pair_after"), removed.alias("removed"), F.coalesce(removed / F.col("all"), F.lit(0.0)).alias("removed_share"),
    )


def ablation_summary(report: DataFrame) -> DataFrame:
    """One row over an :func:`ablation` report: documents changed, tokens removed, medians of the scores before and of the same pairs after."""
    return report.agg(
        F.count(F.when(F.col("changed"), 1)).alias("changed"), F.count(F.when(~F.col("changed"), 1)).alias("unchanged"), F.sum("removed").alias("removed"),
        F.median("before_score").alias("median_before"), F.median("same_pair_after").alias("median_after"),
    )


def literal_excerpts(docs: DataFrame, needle: str, context: int = 60) -> DataFrame:
    """First occurrence of ``needle`` per document that has it: 0-based ``start``, ``end``, and text around."""
    at = F.instr("text", needle)
    size = len(needle)
    found = docs.select("id", "text", at.alias("at")).where("at > 0")
    left = F.greatest(F.lit(1), F.col("at") - context)
    return found.select(
        "id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + size).alias("end"),
        F.substring("text", left, F.col("at") - left).alias("before"), F.substring("text", F.col("at") + size, F.lit(context)).alias("after"),
    )


def pair_category(runs: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Category of each pair from reviewed ``rules(a, b, category)``; pairs that share their first paragraphs take ``default``; others raise when read."""
    return categorised(runs.join(rules, ["a", "b"], "left"), default)


def categorised(judged: DataFrame, default: str) -> DataFrame:
    """:func:`pair_category` of runs that have their reviewed ``category`` beside them, null where there is none."""
    lead = (F.col("para_a") == 0) & (F.col("para_b") == 0)
    missing = F.raise_error(F.concat(F.lit("pair not reviewed: "), F.col("a").cast("string"), F.lit(", "), F.col("b").cast("string"))).cast("string")
    return judged.select("a", "b", "length", F.coalesce("category", F.when(lead, F.lit(default)).otherwise(missing)).alias("category"))
