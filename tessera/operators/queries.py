"""Query logs: language models, suggestion, pinyin correction; and clustering of concepts."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def character_model(texts: DataFrame, text_col: str = "text", kept: str = r"\p{L}", least_bi: float = 0.0015, least_tri: float = 0.00015) -> DataFrame:
    """``(gram, n, p)``: unigram shares, bigram and trigram transition probabilities of adjacent kept characters.

    A bigram is kept if its probability reaches ``least_bi``, a trigram if that of its bigram times its own reaches ``least_tri``.
    """
    chars = texts.select(F.regexp_extract_all(F.col(text_col), F.lit(f"{kept}+"), 0).alias("runs")).select(F.explode("runs").alias("run"))
    spots = chars.select("run", F.explode(F.sequence(F.lit(1), F.char_length("run"))).alias("i"))
    grams = spots.select(F.explode(F.array(*[F.when(F.col("i") + n <= F.char_length("run") + 1, F.substring("run", F.col("i"), F.lit(n))) for n in (1, 2, 3)])).alias("gram")).where("gram is not null")
    counts = grams.groupBy("gram").agg(F.count("*").alias("c")).withColumn("n", F.char_length("gram"))
    uni, bi, tri = (counts.where(F.col("n") == n) for n in (1, 2, 3))
    total = uni.agg(F.sum("c").alias("total"))
    one = uni.join(F.broadcast(total)).select("gram", "n", (F.col("c") / F.col("total")).alias("p"))
    heads = uni.select(F.col("gram").alias("head"), F.col("c").alias("hc"))
    two = bi.withColumn("head", F.substring("gram", 1, 1)).join(heads, "head").select("gram", "n", (F.col("c") / F.col("hc")).alias("p"))
    pair = bi.select(F.col("gram").alias("head"), F.col("c").alias("hc")).join(two.select(F.col("gram").alias("head"), F.col("p").alias("hp")), "head")
    three = tri.withColumn("head", F.substring("gram", 1, 2)).join(pair, "head").withColumn("p", F.col("c") / F.col("hc"))
    three = three.where(F.col("hp") * F.col("p") >= least_tri).select("gram", "n", "p")
    return one.unionByName(two.where(F.col("p") >= least_bi)).unionByName(three)


def update_character_model(model: DataFrame, log: DataFrame, weights: tuple[float, float, float] = (1e-6, 0.004, 0.004)) -> DataFrame:
    """``model`` with ``weight * df`` added for every gram of the logged ``(query, df)``; unseen grams enter."""
    spots = log.select("query", "df", F.explode(F.sequence(F.lit(1), F.greatest(F.char_length("query"), F.lit(1)))).alias("i"))
    parts = [F.struct(F.lit(n).alias("n"), F.when(F.col("i") + n <= F.char_length("query") + 1, F.substring("query", F.col("i"), F.lit(n))).alias("gram"), (F.col("df") * w).alias("p")) for n, w in zip((1, 2, 3), weights)]
    added = spots.select(F.inline(F.array(*parts))).where("gram is not null")
    return model.select("gram", "n", "p").unionByName(added.select("gram", F.col("n"), "p")).groupBy("gram", "n").agg(F.sum("p").alias("p"))


def popular_queries(log: DataFrame, n: int, keep: int | None = None) -> DataFrame:
    """``(query, freq, score)``: best ``5 n`` of ``sum_t ln((c_t + 200 H_t) / (N + 200 sum H + 1) + 1) * sqrt(freq + 0.01)``.

    ``log`` has ``time_id, query, cnt``. ``c_t`` counts the queries with the term, once each;
    ``H_t`` is the entropy of the term over time slices.
    """
    each = log.groupBy("time_id", "query").agg(F.sum("cnt").alias("cnt")).withColumn("term", F.explode(F.array_distinct(tokens(F.col("query")))))
    by_time = each.groupBy("term", "time_id").agg(F.sum("cnt").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("term"))
    terms = by_time.withColumn("h", -p * F.log(p)).groupBy("term").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))
    whole = terms.agg(F.sum("c").alias("all_c"), F.sum("h").alias("all_h"))
    scored = terms.join(F.broadcast(whole)).select("term", F.log((F.col("c") + 200 * F.col("h")) / (F.col("all_c") + 200 * F.col("all_h") + 1) + 1).alias("s"))
    freq = log.groupBy("query").agg(F.sum("cnt").alias("freq")).withColumn("term", F.explode(F.array_distinct(tokens(F.col("query")))))
    out = freq.join(scored, "term").groupBy("query", "freq").agg((F.sum("s") * F.sqrt(F.col("freq") + 0.01)).alias("score"))
    return out.orderBy(F.round("score", 9).desc(), "query").limit(keep or 5 * n)


def realtime_queries(log: DataFrame, n: int, keep: int | None = None) -> DataFrame:
    """``(query, freq, score)``: best ``10 n`` of the latest slice by novelty; ``log`` has ``time_id, query, cnt, is_latest``.

    ``s = freq * sum_t ln(slice_t / (N_slice + 1) + 1)``, novelty is the mean of ``(slice_t + 1) / (period_t + 1)``, the score ``novelty * sqrt(s + 0.01)``.
    """
    each = log.withColumn("term", F.explode(F.array_distinct(tokens(F.col("query")))))
    terms = each.groupBy("term").agg(F.sum(F.when(F.col("is_latest"), F.col("cnt")).otherwise(0)).alias("now"), F.sum(F.when(~F.col("is_latest"), F.col("cnt")).otherwise(0)).alias("past"))
    total = terms.agg(F.sum("now").alias("N"))
    latest = log.where("is_latest").groupBy("query").agg(F.sum("cnt").alias("freq")).withColumn("term", F.explode(F.array_distinct(tokens(F.col("query")))))
    joined = latest.join(terms, "term").join(F.broadcast(total))
    agg = joined.groupBy("query", "freq").agg(F.sum(F.log(F.col("now") / (F.col("N") + 1) + 1)).alias("s"), F.avg((F.col("now") + 1) / (F.col("past") + 1)).alias("novelty"))
    out = agg.select("query", "freq", (F.col("novelty") * F.sqrt(F.col("freq") * F.col("s") + 0.01)).alias("score"))
    return out.orderBy(F.round("score", 9).desc(), "query").limit(keep or 10 * n)


def without_shared_terms(ranked: DataFrame, n: int) -> DataFrame:
    """First ``n`` of a short ranked list ``(query, score)`` that share no term with one kept before. The list is a top-k report."""

    def run(frames):
        frame = pd.concat(list(frames) or [pd.DataFrame(columns=["query", "score", "t"])])
        seen: set[str] = set()
        out = []
        for q, s, t in frame.sort_values(["score", "query"], ascending=[False, True]).itertuples(index=False):
            if len(out) < n and not seen & set(t):
                out.append((q, s))
                seen |= set(t)
        yield pd.DataFrame(out, columns=["query", "score"])

    return ranked.select("query", F.round("score", 9).alias("score"), tokens(F.col("query")).alias("t")).coalesce(1).mapInPandas(run, "query string, score double")


def concept_scores(memberships: DataFrame, global_df: DataFrame, n_corpus: int, least: int = 1) -> DataFrame:
    """``(concept, df, score, rank_score)`` of the concepts of a result set ``(concept, doc_id)``; ``global_df`` has ``concept, g``."""
    d = memberships.groupBy("concept").agg(F.countDistinct("doc_id").alias("df"))
    n_docs = memberships.select("doc_id").distinct().count()
    joined = d.join(global_df, "concept").where(F.col("df") >= least)
    n = float(n_corpus)
    score = F.log(F.col("df") + 1) / F.log((F.sqrt(F.col("g") + 1.0) + 1) / F.log(F.lit(n + 2)) + 2)
    rank = F.log(F.col("df") + 1) / F.log((F.col("g") + F.greatest(F.lit(2.0), F.lit(n / 10000))) / F.log(F.sqrt(F.lit(n + 1)) + 1) + 1)
    common = (F.lit(n_docs) > 10) & (F.col("df") > F.lit(n_docs) / 3.5)
    return joined.select("concept", "df", F.when(common, 0.0).otherwise(score).alias("score"), F.when(common, 0.0).otherwise(rank).alias("rank_score"))


def containment(memberships: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``(a, b, shared, contain)``: share of ``b``'s documents that ``a`` holds too, between the bounds."""
    m = memberships.select("concept", "doc_id").distinct()
    sizes = m.groupBy("concept").agg(F.count("*").alias("n"))
    met = m.select(F.col("concept").alias("a"), "doc_id").join(m.select(F.col("concept").alias("b"), "doc_id"), "doc_id").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = met.join(sizes.withColumnRenamed("concept", "b"), "b").select("a", "b", "shared", (F.col("shared") / F.col("n")).alias("contain"))
    return out.where(F.col("contain").between(low, high))


def sibship(concepts: DataFrame) -> DataFrame:
    """``(a, b, equal)``: concepts of as many terms that agree on a term at the same place, and how often."""
    t = concepts.select("concept", tokens(F.col("concept")).alias("t")).select("concept", F.size("t").alias("n"), F.posexplode("t").alias("i", "term"))
    a, b = t.alias("a"), t.alias("b")
    same = (F.col("a.n") == F.col("b.n")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.concept") < F.col("b.concept"))
    return a.join(b, same).groupBy(F.col("a.concept").alias("a"), F.col("b.concept").alias("b")).agg(F.count("*").alias("equal"))


def concept_tree(scores: DataFrame, contains: DataFrame, least: float = 0.3, depth: int = 3, children: int = 10) -> DataFrame:
    """``(query_id, concept, parent, level)``: greedy tree for each query; a root's parent is null.

    ``scores`` has ``query_id, concept, score`` and ``contains`` ``query_id, a, b, contain``. Again and again the pair
    (placed parent, free child) with the best ``sqrt(containment) * (score + 0.1)`` is joined, while containment allows.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        score = dict(zip(left["concept"], left["score"]))
        inside: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for a, b, c in zip(right["a"], right["b"], right["contain"]):
            if c >= least and b in score and a in score:
                inside[a].append((b, c))
        place: dict[str, tuple[str | None, int]] = {}
        count: dict[str | None, int] = defaultdict(int)
        while len(place) < len(score):
            best = None
            for p, (_, level) in place.items():
                if level < depth and count[p] < children:
                    for c, v in inside[p]:
                        if c not in place:
                            best = max(best or (-1.0,), (v**0.5 * (score[c] + 0.1), c, p, level + 1))
            free = [(s + 0.1, c) for c, s in score.items() if c not in place]
            top = max(free)
            if best is None or (count[None] < children and top[0] > best[0]):
                if count[None] >= children:
                    break
                place[top[1]] = (None, 1)
                count[None] += 1
            else:
                place[best[1]] = (best[2], best[3])
                count[best[2]] += 1
        qid = left["query_id"].iloc[0] if len(left) else 0
        return pd.DataFrame([(qid, c, p, n) for c, (p, n) in place.items()], columns=["query_id", "concept", "parent", "level"])

    return scores.groupBy("query_id").cogroup(contains.groupBy("query_id")).applyInPandas(run, "query_id long, concept string, parent string, level int")


#: Initial and final sounds that typists confuse.
FUZZY_INITIALS = (("c", "ch"), ("s", "sh"), ("z", "zh"), ("l", "n"))
FUZZY_FINALS = (("an", "ang"), ("en", "eng"), ("in", "ing"), ("ue", "ve"))
#: Readings that are no syllables to cut a query into.
FILTERED_SYLLABLES = ("n", "ng", "m", "o")
#: Letter pairs typed the wrong way round.
TYPOS = (("gn", "ng"), ("mg", "ng"))


def pinyin_segments(text: str, syllables: set[str], most: int = 64) -> list[tuple[str, ...]]:
    """All ways to cut ``text`` into known syllables, shortest first, at most ``most``."""
    done: list[list[tuple[str, ...]]] = [[] for _ in range(len(text) + 1)]
    done[0] = [()]
    longest = max(map(len, syllables), default=0)
    for i in range(1, len(text) + 1):
        for j in range(max(0, i - longest), i):
            if text[j:i] in syllables:
                done[i] += [w + (text[j:i],) for w in done[j]]
        done[i] = sorted(done[i], key=lambda w: (len(w), w))[:most]
    return done[-1]


def fuzzy_syllables(syllable: str, syllables: set[str]) -> list[tuple[str, float]]:
    """Known syllables that sound alike: weight 1 for itself, a half for one confusion, a quarter for two."""
    out = {syllable: 1.0}
    for rules, place in ((FUZZY_INITIALS, "start"), (FUZZY_FINALS, "end")):
        for known, w in list(out.items()):
            for a, b in rules:
                for x, y in ((a, b), (b, a)):
                    if place == "start" and known.startswith(x) and not (len(x) < len(y) and known.startswith(y)):
                        new = y + known[len(x) :]
                    elif place == "end" and known.endswith(x) and not (len(x) < len(y) and known.endswith(y)):
                        new = known[: -len(x)] + y
                    else:
                        continue
                    if new in syllables and new not in out:
                        out[new] = w / 2
    return sorted(out.items(), key=lambda kv: (-kv[1], kv[0]))


def correct_pinyin(queries: DataFrame, dictionary: dict[str, list[str]], model: dict[str, float], beam: int = 50) -> DataFrame:
    """``(query, correction, score, rank)``: likely spellings of Latin queries under a character model.

    ``dictionary`` maps syllables to characters, ``model`` grams of one to three characters to probabilities. Both are
    tables of a language, not of the log, and go to every task. A candidate scores the geometric mean of its transitions
    times its reading's weight; it needs 2 to 7 syllables and 0.0005, and the list goes on while a score is 0.7 of the one before.
    """
    syllables = set(dictionary) - set(FILTERED_SYLLABLES)

    def step(chars: str, c: str) -> float:
        if not chars:
            return model.get(c, 0.0)
        return max(model.get(chars[-2:] + c, 0.0) if len(chars) > 1 else 0.0, model.get(chars[-1] + c, 0.0), 1e-6)

    def corrections(text: str) -> list[tuple[str, float]]:
        for a, b in TYPOS:
            text = text.replace(a, b)
        found: dict[str, float] = {}
        for cut in pinyin_segments(text.replace("'", ""), syllables):
            if not 2 <= len(cut) <= 7:
                continue
            states = [("", 1.0, 1.0)]
            for s in cut:
                grown = [(chars + c, p * step(chars, c), w * fw) for chars, p, w in states for f, fw in fuzzy_syllables(s, syllables) for c in dictionary[f]]
                states = sorted(grown, key=lambda x: -x[1] * x[2])[:beam]
            for chars, p, w in states:
                score = p ** (1 / len(chars)) * w
                if score >= 0.0005:
                    found[chars] = max(found.get(chars, 0.0), score)
        ranked = sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))
        out = ranked[:1]
        for r in ranked[1:]:
            if r[1] < 0.7 * out[-1][1]:
                break
            out.append(r)
        return out

    def run(frames):
        for frame in frames:
            rows = [(q, c, s, i + 1) for q in frame["query"] for i, (c, s) in enumerate(corrections((q or "").lower()))]
            yield pd.DataFrame(rows, columns=["query", "correction", "score", "rank"])

    return queries.select("query").mapInPandas(run, "query string, correction string, score double, rank int")


def to_pinyin(texts: DataFrame, readings: DataFrame, text_col: str = "text") -> DataFrame:
    """``(text, position, char, readings, initials)``: readings of each character, by a join on the character ``(char, pinyin)``."""
    spots = texts.select(F.col(text_col).alias("text"), F.posexplode(F.split(F.col(text_col), "")).alias("position", "char")).where("char <> ''")
    by_char = readings.groupBy("char").agg(F.sort_array(F.collect_set("pinyin")).alias("readings"))
    joined = spots.join(by_char, "char", "left")
    return joined.select("text", "position", "char", "readings", F.array_distinct(F.transform("readings", lambda r: F.substring(r, 1, 1))).alias("initials"))
