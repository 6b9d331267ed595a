"""Analysed terms (kinds, stems, options), phrase tests, alignment, shards, ids, sparse cosine, term and topic similarity, title classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import similarity

#: Steps of suffix stripping (the first step of Porter's), as SQL that Spark and DuckDB read alike but for
#: the name of the matching function: each step turns the column of the step before into its own.
STEM_STEPS = (
    ("plural", "term", "case when {m}(term, '(ss|i)es$') then substring(term, 1, length(term) - 2) when {m}(term, '[^s]s$') and length(term) > 2 then substring(term, 1, length(term) - 1) else term end"),
    ("bare", "plural", "case when {m}(plural, '[aeiouy][^aeiouy].*eed$') then substring(plural, 1, length(plural) - 1) when {m}(plural, 'eed$') then plural when {m}(plural, '[aeiouy].*ed$') then substring(plural, 1, length(plural) - 2) when {m}(plural, '[aeiouy].*ing$') then substring(plural, 1, length(plural) - 3) else plural end"),
    ("mended", "bare", "case when bare = plural or {m}(plural, 'eed$') then bare when {m}(bare, '(at|bl|iz)$') then concat(bare, 'e') when {m}(bare, '[^aeiouylsz]$') and right(bare, 1) = substring(bare, length(bare) - 1, 1) then substring(bare, 1, length(bare) - 1) when {m}(bare, '^[^aeiouy]*[aeiouy][^aeiouywx]$') then concat(bare, 'e') else bare end"),
    ("stem", "mended", "case when {m}(mended, '[aeiouy].*y$') then concat(substring(mended, 1, length(mended) - 1), 'i') else mended end"),
)


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, pos, term)``: a text's tokens in order, from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "term"))


def term_kind(term: Column) -> Column:
    """``number``, ``han``, ``latin`` or ``mixed``."""
    return F.when(F.rlike(term, F.lit(r"^\p{N}+$")), "number").when(F.rlike(term, F.lit(r"^\p{IsHan}$")), "han").when(F.rlike(term, F.lit("^[a-z]+$")), "latin").otherwise("mixed")


def stemmed(terms: DataFrame) -> DataFrame:
    """``terms`` (with ``term``) and its ``stem``: English plural, -ed, -ing and -y endings taken off Latin terms."""
    out = terms
    for name, _, rule in STEM_STEPS:
        out = out.withColumn(name, F.expr(rule.format(m="rlike")))
    return out.drop("plural", "bare", "mended").withColumn("stem", F.when(F.rlike("term", F.lit("^[a-z]+$")), F.col("stem")).otherwise(F.col("term")))


def analyse(docs: DataFrame, stop: DataFrame | None = None, least_length: int = 1, kinds: tuple[str, ...] = (), stems: bool = False, merge_numbers: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, pos, term, kind)`` with the options of an analyzer: stop words, lengths, kinds, stems, numbers merged with the word before."""
    out = positions(docs, id_col, text_col)
    out = out.withColumn("kind", term_kind(F.col("term")))
    if merge_numbers:
        row = Window.partitionBy("doc_id").orderBy("pos")
        follows = (F.col("kind") == "number") & (F.lag("kind").over(row) == "latin")
        whole = F.when((F.col("kind") == "latin") & (F.lead("kind").over(row) == "number"), F.concat("term", F.lead("term").over(row))).otherwise(F.col("term"))
        out = out.select("doc_id", "pos", whole.alias("term"), "kind", F.coalesce(follows, F.lit(False)).alias("gone")).where("not gone").drop("gone")
        out = out.withColumn("kind", term_kind(F.col("term")))
    if stems:
        out = stemmed(out).select("doc_id", "pos", F.col("stem").alias("term"), "kind")
    if stop is not None:
        out = out.join(stop.select("term").distinct(), "term", "left_anti")
    out = out.where(F.length("term") >= least_length)
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    return out.select("doc_id", "pos", "term", "kind")


def splits_phrase(term: Column, stop_words: tuple[str, ...]) -> Column:
    """Whether a term ends a phrase: numbers, stop words, single Latin letters."""
    return F.rlike(term, F.lit(r"^\p{N}+$")) | term.isin(*stop_words) | F.rlike(term, F.lit("^[a-z]$"))


def prefix_status(phrases: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """``(phrase, f, status)``: how a phrase counts as the beginning of longer ones.

    ``return`` if it begins with a term that ends phrases, ``none`` if it ends with one, ``candidate`` if a longer
    phrase begins with it, else ``phrase``. ``phrases`` has ``phrase, first, last, prefix, f``.
    """
    longer = phrases.where("prefix <> ''").select(F.col("prefix").alias("phrase")).distinct().withColumn("longer", F.lit(True))
    status = F.when(splits_phrase(F.col("first"), stop_words), "return").when(splits_phrase(F.col("last"), stop_words), "none").when(F.col("longer"), "candidate").otherwise("phrase")
    return phrases.join(longer, "phrase", "left").select("phrase", "f", status.alias("status"))


def drop_near_equal(found: DataFrame) -> DataFrame:
    """``found`` (doc_id, phrase, score) without phrases that are another of the document with at most one character more at an end.

    The longer of such two goes, unless its score is higher; then the shorter goes. Phrases meet on the shorter text.
    """
    cut = F.explode(F.array(F.expr("substring(phrase, 1, length(phrase) - 1)"), F.expr("substring(phrase, 2)"))).alias("short")
    longer = found.where("length(phrase) > 1").select("doc_id", F.col("phrase").alias("long"), F.col("score").alias("long_score"), cut).distinct()
    met = longer.join(found.select("doc_id", F.col("phrase").alias("short"), "score"), ["doc_id", "short"])
    gone = met.select("doc_id", F.when(F.col("long_score") > F.col("score"), F.col("short")).otherwise(F.col("long")).alias("phrase")).distinct()
    return found.join(gone, ["doc_id", "phrase"], "left_anti")


def aligned(left: Column, right: Column) -> Column:
    """Pairs of the i-th of ``left`` and the i-th of ``right``, as long as both last."""
    n = F.least(F.size(left), F.size(right))
    return F.slice(F.arrays_zip(left.alias("left"), right.alias("right")), F.lit(1), n)


def row_shard(row: Column, shards: int) -> Column:
    """The shard, from 0, that a matrix row belongs to."""
    return F.pmod(row, F.lit(shards)).cast("int")


def term_ids(terms: DataFrame, spans: int = 256) -> DataFrame:
    """``(term, id)``: a number from 0 for each distinct term, in order of its hash span, then term; gapless.

    Spans are counted and their terms ranked side by side; only the spans' counts come together.
    """
    known = terms.select("term").distinct().withColumn("span", F.pmod(F.crc32("term"), F.lit(spans)))
    counts = known.groupBy("span").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("span", before.alias("first"))
    rank = F.row_number().over(Window.partitionBy("span").orderBy("term")) - 1
    return known.withColumn("r", rank).join(first, "span").select("term", (F.col("first") + F.col("r")).alias("id"))


def sparse_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(a, b, cosine)`` for each of ``pairs`` (a, b) of sparse ``vectors`` (id, dim, value); -100 where either has no length."""
    norm = vectors.groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("norm"))
    left, right = vectors.select(F.col("id").alias("a"), "dim", F.col("value").alias("x")), vectors.select(F.col("id").alias("b"), "dim", F.col("value").alias("y"))
    inner = pairs.join(left, "a").join(right, ["b", "dim"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("inner"))
    out = pairs.join(inner, ["a", "b"], "left").join(norm.select(F.col("id").alias("a"), F.col("norm").alias("na")), "a", "left").join(norm.select(F.col("id").alias("b"), F.col("norm").alias("nb")), "b", "left")
    length = F.sqrt(F.col("na")) * F.sqrt(F.col("nb"))
    return out.select("a", "b", F.when(F.coalesce(length, F.lit(0.0)) == 0, F.lit(-100.0)).otherwise(F.coalesce("inner", F.lit(0.0)) / length).alias("cosine"))


def similar_terms(counts: DataFrame, threshold: float = 0.4, k: int = 10, dims: int = 5000) -> DataFrame:
    """``(id, other, sim, rank)``: terms of similar contexts, by random indexing, unit vectors, all pairs above ``threshold``, the ``k`` best of each.

    ``counts`` has ``term, context, n``.
    """
    units = similarity.normalise(similarity.random_index(counts, dims))
    return similarity.similar_lists(similarity.all_pairs(units, threshold), k)


def linked_topics(series: DataFrame, threshold: float = 0.8, k: int = 10) -> DataFrame:
    """``(id, other, sim, rank)``: topics whose smoothed daily values, ``(topic, day, value)``, are alike; each topic's ``k`` best above ``threshold``."""
    units = similarity.normalise(series.where("value <> 0").select(F.col("topic").alias("id"), F.col("day").alias("dim"), "value"))
    return similarity.similar_lists(similarity.all_pairs(units, threshold), k)


def merged_text(topics: DataFrame) -> DataFrame:
    """``(group, text)``: a group's texts, longest first, joined by commas, without those that lie inside a longer one."""
    listed = topics.select("group", "text").distinct().groupBy("group").agg(F.sort_array(F.collect_list(F.struct((-F.length("text")).alias("n"), "text"))).alias("each"))
    texts = F.transform("each", lambda x: x["text"])
    kept = F.filter(texts, lambda x, i: ~F.exists(F.slice(texts, F.lit(1), F.greatest(i, F.lit(0))), lambda y: F.contains(y, x)))
    return listed.select("group", F.array_join(kept, ",").alias("text"))


def bayes_train(docs: DataFrame) -> DataFrame:
    """``(class, term, weight)`` of ``docs`` (class, terms): add-one log shares of a class's terms; a null term holds the log share of its documents."""
    n = docs.select(F.count("*").alias("n"))
    prior = docs.groupBy("class").agg(F.count("*").alias("c")).join(n).select("class", F.lit(None).cast("string").alias("term"), F.log(F.col("c") / F.col("n")).alias("weight"))
    each = docs.select("class", F.explode("terms").alias("term"))
    counted = each.groupBy("class", "term").agg(F.count("*").alias("c"))
    kinds = each.select(F.countDistinct("term").alias("kinds"))
    whole = counted.groupBy("class").agg(F.sum("c").alias("whole")).join(kinds)
    seen = counted.join(whole, "class").select("class", "term", F.log((F.col("c") + 1) / (F.col("whole") + F.col("kinds"))).alias("weight"))
    return seen.unionByName(prior).unionByName(whole.select("class", F.lit("").alias("term"), F.log(1 / (F.col("whole") + F.col("kinds"))).alias("weight")))


def bayes_classify(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``(row_id, class, score)``: the likeliest class of rows ``(row_id, terms)``, ties to the first; terms that a class lacks count as unseen.

    Classes are few: each row meets each class once, by an exploded list of them.
    """
    prior = model.where("term is null").select("class", F.col("weight").alias("prior"))
    unseen = model.where("term = ''").select("class", F.col("weight").alias("unseen"))
    known = model.where("term <> ''").join(unseen, "class").select("class", "term", (F.col("weight") - F.col("unseen")).alias("gain"))
    each = rows.select("row_id", F.explode("terms").alias("term"))
    gained = each.join(known, "term").groupBy("row_id", "class").agg(F.sum("gain").alias("gain"))
    classes = [r["class"] for r in prior.select("class").orderBy("class").collect()]
    every = rows.select("row_id", F.size("terms").alias("n"), F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    scored = every.join(gained, ["row_id", "class"], "left").join(prior, "class").join(unseen, "class", "left")
    score = F.col("prior") + F.col("n") * F.coalesce("unseen", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))
    best = F.row_number().over(Window.partitionBy("row_id").orderBy(F.round("score", 9).desc(), "class"))
    return scored.withColumn("score", score).withColumn("r", best).where("r = 1").select("row_id", "class", "score")


def contained_labels(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """``(label, n)``: how many of ``texts`` (text) hold each of ``labels`` (label) as a substring.

    Texts offer their substrings of those lengths that labels have, so labels are met by an equi-join.
    """
    lengths = [r["n"] for r in labels.select(F.length("label").alias("n")).distinct().orderBy("n").collect() if r["n"]]
    if not lengths:
        return labels.select("label", F.lit(0).cast("long").alias("n")).limit(0)
    parts = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i, n=n: F.substring("text", i, F.lit(n))) for n in lengths]))
    offered = texts.select(F.explode(F.array_distinct(parts)).alias("label"))
    found = offered.join(labels.select("label").distinct(), "label").groupBy("label").agg(F.count("*").alias("n"))
    return labels.select("label").distinct().join(found, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
