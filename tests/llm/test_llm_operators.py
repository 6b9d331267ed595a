"""Each operator against a brute-force version on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import hypergeometric as hg
from tessera.llm import op1_ann, op2_line_dedup, op3_mixing, op4_toxicity, op5_chat, op6_language, op7_quality, op8_simhash, op9_sharding, op10_bpe
from tessera.llm.queries import tokenizer_definition

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(n=120, seed=3):
    rng = random.Random(seed)
    words = {"en": ["the", "of", "and", "thing", "whether", "shall", "nothing"], "de": ["der", "und", "nicht", "schön", "straße", "größe", "auch"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", ".", ",\n"]) for _ in range(rng.choice([1, 5, 60, 200])))
        rows.append((i, text, lang, rng.choice(["a", "b", "b", None]), len(text)))
    base = rows[5][1] + " and a longer tail of words to make a text of some length here"
    rows += [(200 + i, base, "en", "a", 1) for i in range(6)]
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \t\n ", "de", "b", 4), (303, "?!?", "en", "a", 3)]
    rows += [(304, "word " * 30_000, "en", "c", 150_000), (305, "x" * 50_000, "en", "c", 50_000)]
    rows += [rows[7], rows[7], (None, "no id here at all", "en", "a", 5)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Columns whose names the operators use themselves."""
    names = "id fp s h row key shard slot rank block n size target copy lines marks host page value bucket".split()
    return df.select("*", *[F.lit(1).alias(x) for x in names])


# --- draws ---


def test_hypergeometric_matches_its_law():
    rng = np.random.default_rng(0)
    got = Counter(hg.hypergeometric(rng, 6, 9, 5) for _ in range(20_000))
    from math import comb

    for k in range(6):
        assert abs(got[k] / 20_000 - comb(6, k) * comb(9, 5 - k) / comb(15, 5)) < 0.015
    assert 0 <= hg.hypergeometric(rng, 5_000_000_000, 7_000_000_000, 3_000_000_000) <= 3_000_000_000


def test_matrix_and_tree_have_exact_margins():
    rng = np.random.default_rng(1)
    m = np.array(hg.communication_matrix(rng, [5, 0, 9, 30], [11, 11, 22]))
    assert m.sum(1).tolist() == [5, 0, 9, 30] and m.sum(0).tolist() == [11, 11, 22]
    t = np.array(hg.splitting_tree(rng, [7, 0, 20], [9, 9, 9]))
    assert t.sum(0).tolist() == [7, 0, 20] and t.sum(1).tolist() == [9, 9, 9]


# --- op1 ---


def brute_nearest(rows, k):
    """Lists ``(score, id)`` of every query row, by its id."""
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = Counter(len(v) for _, v in fine).most_common(1)[0][0]
    fine = [(i, v) for i, v in fine if len(v) == dim]
    out = defaultdict(list)
    for n, (i, v) in enumerate(fine):
        if i % 20 == 0:
            out[i].append(sorted(((float((x * v).sum()), j) for m, (j, x) in enumerate(fine) if m != n), key=lambda t: (-t[0], t[1]))[:k])
    return out


@pytest.mark.parametrize("cell_rows", [op1_ann.CELL_ROWS, 60])
def test_op1_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=70)]) for i in range(600)]
    rows += [(i, rows[3][1]) for i in range(600, 630)] + [(700, None), (701, [0.0] * 70), (702, [1.0, None] + [0.0] * 68), (703, [float("nan")] * 70), (720, [1.0, 2.0]), (None, [1.0] * 70), rows[20], (40, rows[41][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("code", F.lit("x")).withColumn("asked", F.lit(True))
    out = op1_ann.nearest(df, F.col("vec_id") % 20 == 0, cell_rows=cell_rows, slice_rows=(150, 150), block_queries=8).collect()
    got = defaultdict(list)
    for r in out:
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    want = brute_nearest(rows, 20)
    assert set(got) == set(want) and all(sorted(x[0] for x in got[q]) == sorted(list(range(1, 21)) * len(want[q])) for q in want)
    hits = sum(len(set(x[1:] for x in got[q]) & {t for lists in want[q] for t in lists}) for q in want) / sum(len({t for lists in want[q] for t in lists}) for q in want)
    assert hits >= 0.99
    outside = op1_ann.nearest(df, queries=spark.createDataFrame([(1, rows[5][1])], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in outside][0] == (1, 5) and len(outside) == 20


def test_op1_estimates_keep_their_bounds():
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(3000, 96)), rng.normal(size=(40, 96))
    turn, centre = op1_ann.rotation(96), x.mean(axis=0)
    codes, radius, align = op1_ann.encode(x, centre, turn)
    near, bound = op1_ann.estimate(q, centre, turn, codes, radius, align, op1_ann.EPSILON)
    miss = np.abs(near - q @ x.T)
    # One bit a coordinate leaves sqrt(pi / 2 - 1) = 0.755 of the spread of random vectors' products.
    assert (miss <= bound).mean() > 0.98 and 0.70 < miss.mean() / np.abs(q @ x.T).mean() < 0.80


def test_op1_reranks_a_smaller_share_of_more_rows(spark):
    """At the shipped settings, over random unit vectors, which have no neighbourhoods: recall, and what it costs."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    share = []
    for n in (2_000, 12_000):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:n])], "vec_id long, embedding array<double>")
        out = op1_ann.nearest(df, F.col("vec_id") % 200 == 0).collect()
        hits = 0
        for i in range(0, n, 200):
            score = x[:n] @ x[i]
            score[i] = -9
            hits += len({r.vec_id for r in out if r.query_id == i} & set(np.argsort(-score)[:20].tolist()))
        assert hits / (20 * n / 200) >= 0.99
        share.append(np.mean([r.reranked for r in out]) / n)
    assert share[1] < 0.6 * share[0]


def test_op1_leaves_cells_out(spark):
    """Far clusters cannot reach the floor, and are not looked into."""
    rng = np.random.default_rng(12)
    spots = 10 * rng.normal(size=(8, 32))
    x = np.concatenate([s + 0.2 * rng.normal(size=(500, 32)) for s in spots])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = op1_ann.nearest(df, F.col("vec_id") % 100 == 0, cell_rows=500).collect()
    assert np.mean([r.reranked for r in out]) < 600 + 160 and len(out) == 40 * 20


def test_op1_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op1_ann.search_embeddings(none).count() == 0


# --- op2 ---


def test_op2_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        host = rng.choice(["h1", "h1", "h2", None])
        lines = [f"line {rng.random()}" for _ in range(3)] + ["  nav " + str(host)] * (i % 4 != 0) + ["", "shared"] * (host == "h1" and i % 9 == 0)
        rows.append((i, host, "\n".join(lines)))
    rows += [(100, "h1", None), (101, "h1", ""), (102, "tiny", "only\nhere"), rows[0], (103, None, "nav None")]
    df = clashing(spark.createDataFrame(rows, "page_id long, site string, text string"))
    got = sorted((r.page_id, r.site or "", r.text, r._dropped_lines) for r in op2_line_dedup.drop_boilerplate(df, "site", "text", 0.3, 5).collect() if r.text is not None)
    pages, seen = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        seen.update({(h, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    drop = {k for k, n in seen.items() if n >= 5 and n > 0.3 * pages[k[0]]}
    want = []
    for i, h, t in rows:
        if t is not None:
            kept = [x for x in t.split("\n") if (h, x.strip(" ")) not in drop]
            want.append((i, h or "", "\n".join(kept), t.count("\n") + 1 - len(kept)))
    assert got == sorted(want) and any(w[3] for w in want)


def test_op2_keeps_columns_of_any_name(spark):
    names = ["_host", "_none", "_marks", "_kept", "page", "at", "none", "kept", "marks", "a.b", "text2"]
    df = spark.createDataFrame([(i, "h", f"own {i}\nnav") for i in range(4)], "page_id long, site string, text string").select("*", *[F.lit(x.upper()).alias(x) for x in names])
    out = op2_line_dedup.drop_boilerplate(df, "site", "text").collect()
    assert all(r[x] == x.upper() for r in out for x in names) and sorted(r.text for r in out) == [f"own {i}" for i in range(4)]


def test_op2_small_hosts_and_hostile_pages(spark):
    pages = [(1, "http://a.b/1", "<p>one</p><p>nav</p>"), (2, "http://a.b/2", "<p>two</p><p>nav</p>"), (3, "http://c.d/", "<p>only</p>"), (4, "http://a.b/3", "<p>x</p><!-- never closed <p>nav</p>")]
    pages += [(5, None, "<" * 200_000 + "end"), (6, "no url", "<script>" * 20_000), (7, "http://e.f/", None), (8, "http://a.b/4", "<p>y</p>" + "long " * 200_000)]
    out = {r.page_id: r for r in op2_line_dedup.dedup_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[1].text.split() == ["one"] and out[2].text.split() == ["two"] and out[3].text.split() == ["only"] and out[4].text.split() == ["x"]
    assert out[7].text is None and len(out[8].text.split()) == 200_001 and out[5].host is None and out[6].host == ""


def test_op2_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert op2_line_dedup.dedup_pages(none).count() == 0


# --- op3 ---


def test_water_fill():
    t = op3_mixing.water_fill([10, 1000, 0, 500], [3, 1, 2, 3])
    assert t[0] == 20 and t[2] == 0 and abs(sum(t) - 1.5 * 1510) < 1e-9 and all(x <= 2 * s for x, s in zip(t, [10, 1000, 0, 500]))


def test_op3_laws_and_reruns(docs):
    first = op3_mixing.mix_documents(clashing(docs)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert len(first) == docs.count()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, op3_mixing.mix_documents(clashing(docs)).collect()), key=str)
    sizes, taken, target = Counter(), Counter(), {}
    for r in sorted(first, key=key):
        assert r.taken <= 2 * r["size"] and r.taken in (0, r["size"], 2 * r["size"])
        sizes[r.source_size] += r["size"]
        taken[r.source_size] += r.taken
        target[r.source_size] = (r.target, max(r["size"], target.get(r.source_size, (0, 0))[1]))
    for s in sizes:
        assert sizes[s] == s and abs(taken[s] - target[s][0]) <= target[s][1] / 2 + 1


def test_op3_rows_follow_the_counts(docs):
    counts = Counter()
    for r in op3_mixing.mix_documents(docs).collect():
        counts[r.doc_id] += r.copies
    rows = op3_mixing.mixed_rows(clashing(docs)).collect()
    assert Counter(r.doc_id for r in rows) == +counts
    shards = Counter(r._mix_shard for r in rows)
    assert set(shards) <= set(range(16))


def test_op3_draw_against_brute_force(spark):
    """The same blocks, quotas and shards by plain lists; each block goes to one shard a turn, and shards are as full as the tree says."""
    rng = random.Random(6)
    blocks = [(s, b, rng.randrange(1, 90)) for s, n in ((0, 40), (1, 7), (2, 1)) for b in range(n)] + [(1, 7, 0)]
    size = Counter()
    for s, _, w in blocks:
        size[s] += w
    targets = {0: size[0] * 1.3, 1: size[1] * 2.0, 2: 0.5}
    df = spark.createDataFrame(blocks, "sid int, block long, words long")
    known = spark.createDataFrame([(s, float(t), 3) for s, t in targets.items()], "sid int, target double, ranges long")
    drawn = op3_mixing.draw(df, known, 3, 4, 7, 2.0).collect()
    assert len({(r.sid, r.block, r.turn) for r in drawn}) == len(drawn)
    words = {(s, b): w for s, b, w in blocks}
    for s, t in targets.items():
        mine = [r for r in drawn if r.sid == s]
        assert abs(sum(words[s, r.block] if r.cut is None else r.cut for r in mine) - t) < 1e-6
        if t >= size[s]:
            assert {r.block for r in mine if r.turn == 0} == {b for x, b, w in blocks if x == s and w}
    counts = [sum(r.sid == s for r in drawn) for s in range(3)]
    capacity = [(sum(counts) + 3 - i) // 4 for i in range(4)]
    tree = hg.splitting_tree(np.random.default_rng(7), counts, capacity)
    assert [[sum(r.sid == s and r.shard == i for r in drawn) for s in range(3)] for i in range(4)] == tree


def test_op3_takes_what_the_tree_deals(docs, monkeypatch):
    taken = op3_mixing.mix_documents(docs).agg(F.sum("taken")).first()[0]
    monkeypatch.setattr(op3_mixing, "splitting_tree", lambda rng, quotas, capacities: [[0] * len(quotas) for _ in capacities])
    assert taken > 0 and op3_mixing.mix_documents(docs).agg(F.sum("taken")).first()[0] == 0


def test_op3_keeps_columns_of_its_own_names(docs):
    names = ["row", "block", "sid", "turn", "_mix", "_mix_row", "_mix_key", "cut", "at", "h"]
    out = op3_mixing.mixed_rows(docs.select("*", *[F.lit(x).alias(x) for x in names])).limit(20).collect()
    assert out and all(r[x] == x for r in out for x in names)


def test_op3_empty(empty):
    assert op3_mixing.mix_documents(empty).count() == 0


# --- op4 ---


def test_op4_learns_pairs():
    rng = random.Random(4)
    docs, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        words = {f"w{rng.randrange(200)}" for _ in range(10)} | ({"insult"} if a else set()) | ({"group"} if b else set())
        docs.append(op4_toxicity.terms(" ".join(sorted(words))))
        labels.append(int(a and b))
    machine = op4_toxicity.train(docs, np.array(labels))
    s = {t: machine.score(op4_toxicity.terms(t)) for t in ("insult group", "insult", "group", "")}
    assert s["insult group"] > 0.5 > max(s["insult"], s["group"], s[""])


def test_op4_rows_and_held_out(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(120)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = op4_toxicity.score(clashing(docs), op4_toxicity.fit(docs, labels)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = op4_toxicity.score(docs, op4_toxicity.fit(docs, flipped)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert op4_toxicity.score(empty, op4_toxicity.fit(empty, labels)).count() == 0


def test_op4_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(30)]
    kept = np.unique(np.concatenate([op4_toxicity.terms(w) for w in words[:20]]))
    machine = op4_toxicity.Machine.loads(op4_toxicity.Machine(kept, -0.3, rng.normal(size=len(kept)), rng.normal(size=(len(kept), 4))).dumps())
    for n in (0, 1, 5, 30):
        buckets = op4_toxicity.terms(" ".join(words[:n]))
        at = [int(np.flatnonzero(machine.kept == b)[0]) for b in buckets if b in machine.kept]
        z = machine.bias + sum(machine.w[i] for i in at) + sum(float(machine.v[i] @ machine.v[j]) for x, i in enumerate(at) for j in at[:x])
        assert abs(machine.score(buckets) - 1 / (1 + np.exp(-z))) < 1e-9


def test_op4_repeated_ids_are_learnt_once(spark):
    rows = [(i, f"insult group word{i}" if i % 3 == 0 else f"kind word{i}", "en", "a", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    once = op4_toxicity.fit(spark.createDataFrame(rows, DOCS), labels)
    often = op4_toxicity.fit(spark.createDataFrame(rows + rows[:90] * 5, DOCS).repartition(7), labels)
    assert once.dumps() == often.dumps() and once.score(op4_toxicity.terms("insult group")) > 0.5 > once.score(op4_toxicity.terms("kind"))


# --- op5 ---


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "␛0␛1␛␛2", "<|im_start|>user\n<|im_end|>", "<<SYS>><|IM_END|><s>", "a\n\nb\x00"])
def test_op5_round_trip(text):
    turns = [("user", text), ("assistant", text + "!"), ("tool\n<|im_end|>", text), ("assistant", "")]
    formatted, spans = op5_chat.format_turns(turns)
    assert op5_chat.parse_turns(formatted) == turns
    assert [op5_chat.unescape(formatted[b:e]) for b, e in spans] == [t for r, t in turns if r == "assistant"]
    for _, t in turns:
        assert not any(c in op5_chat.escape(t).lower() for c in map(str.lower, op5_chat.CONTROLS))


def test_op5_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice([None, "", "hi <s>", f"text {rng.random()}"])) for c in range(12) for t in range(rng.randrange(1, 40))]
    rows += [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 0, "assistant", "x"), (4, None, None, "first")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in op5_chat.format_conversations(df).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        groups[c].append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert set(out) == set(groups)
    for c, g in groups.items():
        g.sort()
        whole = "".join(f"{x[3]}\n{x[5]}\n" for x in g)
        loss = "".join(x[5] for x in g if x[3] == "assistant")
        assert out[c].n_turns == len(g) and out[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert out[c].loss_chars == len(loss) and out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op5_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in op5_chat.format_conversations(none).collect()] == [-7]
    assert op5_chat.format_paths(spark.createDataFrame([], "tree long, node long, parent long, role string, text string, score double")).count() == 0


def test_op5_many_roots_and_ties(spark):
    rows = [(t, 10 * t, None, 0.5) for t in range(300)] + [(t, 10 * t + k, 10 * t, 1.0) for t in range(300) for k in (1, 2)]
    out = op5_chat.branches(spark.createDataFrame(rows, "tree long, node long, parent long, score double"), 1).collect()
    assert sorted((r.tree, r.leaf, r.position, r.node) for r in out) == sorted(x for t in range(300) for x in ((t, 10 * t + 1, 0, 10 * t), (t, 10 * t + 1, 1, 10 * t + 1)))


def test_op5_branches(spark):
    #       1 -> 2 -> 4 ; 1 -> 3 ; orphan 9 ; cycle 6 <-> 7
    rows = [(0, 1, None, 1.0), (0, 2, 1, 0.0), (0, 4, 2, 0.0), (0, 3, 1, 0.9), (1, 9, 77, None), (2, 6, 7, 1.0), (2, 7, 6, 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    best = sorted(tuple(r) for r in op5_chat.branches(df, 1).collect())
    assert best == [(0, 3, 0, 1), (0, 3, 1, 3), (1, 9, 0, 9)]
    both = sorted(tuple(r) for r in op5_chat.branches(df, 5).where("tree = 0").collect())
    assert both == [(0, 3, 0, 1), (0, 3, 1, 3), (0, 4, 0, 1), (0, 4, 1, 2), (0, 4, 2, 4)]


# --- op6 ---


def brute_phrases(text: bytes, learnt: bytes) -> int:
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in learnt:
            k += 1
        n, i = n + 1, i + max(1, k - 1)
    return n


def test_op6_phrases_match_brute_force():
    rng = random.Random(6)
    words = ["the", "thing", "other", "of", "nothing", "der", "und", "die", "nicht", "schön", "qu", "a"]
    story = lambda n: " ".join(rng.choice(words) + rng.choice(["", "e", "ing", ".", "日"]) for _ in range(n))
    samples = {"x": ["the thing and the other thing of nothing"], "y": ["der und die nicht schön"], "z": [story(900), "aaaa"]}
    model = op6_language.train(samples)
    texts = ["nothing of the thing", "schön und nicht", "zzz the", "", "Ünd Ä日本", *(story(n) for n in (1, 60, 300, 1000)), samples["z"][0], "a" * 5000, "ab" * 400 + "a" * 300]
    learnt = [bytes(op6_language.normalise(samples[k])[0]) for k in model]
    for rounds in (0, 1, 6):
        op6_language._ROUNDS = rounds
        count, length, _ = op6_language.counted(texts, model)
        for i, t in enumerate(texts):
            data = bytes(op6_language.normalise([t])[0])
            assert length[i] == len(data) and count[i].tolist() == [brute_phrases(data, x) for x in learnt], (rounds, i)
    assert count[texts.index(samples["z"][0])][2] == 1  # a text that was learnt is one phrase


def test_op6_long_texts_in_slices(monkeypatch):
    rng = random.Random(9)
    long = " ".join(rng.choice(["the", "thing", "of,", "nothing", "4", "日本", "schön"]) for _ in range(500_000))
    assert len(long) > 2_000_000 > op6_language._SLICE_CHARS
    model = op6_language.train({"x": ["the thing and the other thing of nothing"], "y": ["der und die nicht schön 日本"]})
    sliced = op6_language.counted([long, "the thing"], model)
    monkeypatch.setattr(op6_language, "_SLICE_CHARS", 10_000_000)
    whole = op6_language.counted([long, "the thing"], model)
    assert all((a == b).all() for a, b in zip(sliced, whole))
    data = op6_language.normalise([long])[0]
    for k, a in enumerate(model.values()):
        ended, state = a.parse(data, 0)
        assert ended + (state != 0) == whole[0][0][k]


def test_op6_many_languages(spark):
    rng = random.Random(60)
    alphabets = [rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñ", 12) for _ in range(60)]
    rows = [(i, " ".join("".join(rng.choice(alphabets[i % 60]) for _ in range(rng.randrange(2, 8))) for _ in range(120)), f"l{i % 60:02}", None, None) for i in range(1200)]
    rows.append((5000, "ж" * 9_000, "long-only", None, None))
    df = spark.createDataFrame(rows, DOCS)
    model = op6_language.fit(df)
    assert len(model) == 61 and sum(a.slots.nbytes for a in model.values()) < 200_000_000
    out = op6_language.predict_documents(df).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in out if r.held_out and r.doc_id < 1200) / sum(r.held_out and r.doc_id < 1200 for r in out) > 0.97
    assert next(r for r in out if r.doc_id == 5000).lang_pred == "long-only"


def test_op6_rows(docs, empty):
    out = op6_language.predict_documents(clashing(docs)).collect()
    assert len(out) == docs.count()
    want = {r[0]: r for r in awkward()}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in want[r.doc_id][1] or ""):
            assert r.lang_pred == "und"
    long = [r for r in out if r.doc_id is not None and r.doc_id < 120 and len(want[r.doc_id][1]) > 150]
    assert sum(r.lang_pred == want[r.doc_id][2] for r in long) / len(long) > 0.97
    assert op6_language.predict_documents(empty).count() == 0


# --- op7 ---


def brute_features(text):
    words = text.encode().split()
    count = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


@pytest.mark.parametrize("text", ["", "a", "a b c a b c", "x y\nx y\n \nx y", "é#*|<> z z z z z", "a\x1cb c\x0bd a\x1cb c d"])
def test_op7_features(text):
    assert op7_quality.features(text) == brute_features(text)


def test_op7_rows(docs, empty):
    out = op7_quality.quality(clashing(docs)).collect()
    assert len(out) == docs.count()
    text = {r[0]: r[1] or "" for r in awkward()}
    for r in out:
        f = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert f == brute_features(text[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert op7_quality.quality(empty).count() == 0


def brute_kept(rows):
    """Verdicts of ``(lang, source, features)`` rows by whole sorted lists, weighted as the sketches are."""
    import math

    values = [(f[2] + 1) / (f[0] + 1) for *_, f in rows], [(f[3] + 1) / (f[0] + 1) for *_, f in rows], [(f[4] + 1) / (f[0] + 1) for *_, f in rows], [f[1] / max(f[0], 1) for *_, f in rows]
    good = [i for i, (*_, f) in enumerate(rows) if f[0] >= 50 and 2 * f[4] <= f[0]]
    kept = [i in set(good) for i in range(len(rows))]
    for measure, of in zip(op7_quality.MEASURES, values):
        at = {i: math.floor(math.log(of[i]) / op7_quality._LOG) for i in good}
        every, upper = Counter(at.values()), defaultdict(Counter)
        for i in good:
            upper[rows[i][0]][at[i]] += 1
        for group in {rows[i][:2] for i in good}:
            own = Counter({b: n * 10**6 for b, n in Counter(at[i] for i in good if rows[i][:2] == group).items()})
            for counts in (upper[group[0]], every):
                own.update({b: n * op7_quality.PRIOR_DOCS * 10**6 // sum(counts.values()) for b, n in counts.items()})
            whole, run, q = sum(own.values()), 0, {}
            for b in sorted(own):
                run += own[b]
                for k in (1, 3):
                    if 4 * run >= k * whole:
                        q.setdefault(k, b)
            reach = op7_quality.SPREADS[measure] * max(op7_quality.LEAST_SPREAD, q[3] - q[1])
            for i in good:
                if rows[i][:2] == group and (at[i] > q[3] + reach or measure == "word_length" and at[i] < q[1] - reach):
                    kept[i] = False
    return kept


def quality_rows(symbols, n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["alpha", "be", "gamma", "delta", "of", "zeta", "in"]) + rng.choice(["", "x", "yy", "zzz"]) + str(rng.randrange(500)) for _ in range(rng.choice([30, 60, 90, 150, 400, 900]))]
        source = rng.choice(["a", "a", "b", None])
        for k in range(len(words)):
            if rng.random() < symbols.get(source, 0) or i % 23 == 0 and rng.random() < 0.4:
                words[k] += "#"
        rows.append((i, " ".join(words), rng.choice(["en", None]), source, None))
    return rows


def test_op7_verdicts_against_brute_force(spark):
    found = {}
    for name, symbols in (("plain", {}), ("shifted", {"b": 0.5})):
        rows = quality_rows(symbols)
        out = {r.doc_id: r.kept for r in op7_quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
        want = brute_kept([(lang, source, brute_features(t)) for _, t, lang, source, _ in rows])
        assert [out[r[0]] for r in rows] == want
        found[name] = {r[0] for r, k in zip(rows, want) if not k and len(r[1].split()) >= 50 and r[0] % 23 == 0 and r[3] == "b"}
    # Once most of a group holds symbols, a document with as many is no longer rejected.
    assert found["plain"] and not found["shifted"]


def test_op7_fences_differ_between_groups(spark):
    rows = op7_quality.measured(spark.createDataFrame(quality_rows({"a": 0.1}), DOCS)).where("n_words >= 50")
    limits = op7_quality.fences(op7_quality.filled(op7_quality.sketches(rows, ["lang", "source"], op7_quality.MEASURES))).collect()
    assert len(limits) == 6 and len({r.symbols.high for r in limits}) >= 4


def test_op7_sketches_merge(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(1000)], "g int, v double")
    q = op7_quality.sketches(df, ["g"], {"symbols": "v"}).groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    whole = op7_quality.sketches(df.withColumn("g", F.lit(0)), ["g"], {"symbols": "v"}).drop("g")
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, whole.select("measure", "bin", "n").collect()))


# --- op8 ---


def brute_components(rows, radius=4):
    prints = []
    for _, t, *_ in rows:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    part = list(range(len(rows)))

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                part[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), format(p, "016x"), str(low.get(find(i)))) for i, (r, p) in enumerate(zip(rows, prints)))


@pytest.mark.parametrize("shard_rows", [8192, 3])
def test_op8_against_brute_force(spark, docs, shard_rows):
    out = op8_simhash.near_duplicates(clashing(docs), shard_rows=shard_rows).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == brute_components(awkward())


def test_op8_links_lose_nothing(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for b in base for _ in range(30)}
    rows = [(p - 2**64 if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    from tessera.plans.components import connected_components

    for shard_rows in (8192, 10):
        links = op8_simhash.links(spark.createDataFrame(rows, "fp long, low long"), 4, shard_rows)
        got = defaultdict(set)
        for r in connected_components(links, "a", "b").collect():
            got[r.root].add(r.node)
        todo, want = {p for p, _ in rows}, []
        while todo:
            group, new = set(), {todo.pop()}
            while new:
                group |= new
                new = {q for q in todo for p in new if ((p ^ q) & (2**64 - 1)).bit_count() <= 4}
                todo -= new
            want.append(frozenset(group))
        assert {frozenset(g) for g in got.values()} == {g for g in want if len(g) > 1}


def test_op8_crowded_shards_stay_bounded(spark):
    """9,000 fingerprints that differ in 16 bits only, and 3,000 around one: no shard above the limit, few rows, no link lost."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    spots = rng.sample(range(64), 16)
    dense = {base ^ sum(1 << b for i, b in enumerate(spots) if x >> i & 1) for x in rng.sample(range(1 << 16), 9_000)}
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(3_000)}
    signed = lambda p: p - 2**64 if p >> 63 else p
    df = spark.createDataFrame([(signed(p), i) for i, p in enumerate(sorted(dense | near))], "fp long, low long")
    for limit in (8192, 512):
        rows = op8_simhash.shards(df, 4, limit)
        sizes = [r["count"] for r in rows.groupBy("s").count().collect()]
        assert max(sizes) <= 1.25 * limit
        if limit == 8192:
            assert sum(sizes) < 10 * (len(dense) + len(near)) * 2
    met = defaultdict(set)
    for r in rows.distinct().collect():
        met[r.fp].add(r.s)
    some = rng.sample(sorted(dense), 60)
    for p in some:
        for q in dense:
            if p != q and (p ^ q).bit_count() <= 4:
                assert met[signed(p)] & met[signed(q)]


def test_op8_empty(empty):
    assert op8_simhash.near_duplicates(empty).count() == 0


# --- op9 ---


@pytest.mark.parametrize("block_rows", [25_000, 4])
def test_op9_laws(docs, block_rows):
    out = op9_sharding.shard_documents(clashing(docs), block_rows=block_rows).collect()
    text = {r[0]: (r[1] or "").encode() for r in awkward()}
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r.slot)
        assert r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None
    assert len(out) == docs.count() and set(shards) == set(range(16))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    again = op9_sharding.shard_documents(docs, block_rows=block_rows).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_op9_is_uniform(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("size"))
    out = op9_sharding.shuffle_shards(rows, 4, 1, 100).collect()
    first = Counter(r.shard for r in out if r.doc_id < 2000)
    assert all(abs(first[s] - 500) < 70 for s in range(4))


def test_op9_empty(empty):
    assert op9_sharding.shard_documents(empty).count() == 0


# --- op10 ---


@pytest.fixture(scope="module")
def definition():
    return tokenizer_definition()


HARD = ["It's we'll 42nd", "<|endoftext|>x<|startoftext|>", "A\x1cB\x85C D E", "İstanbul ΣΑΣ ǅ J̌ ﬁ", "日本語 текст 🎉🎉 é", "​﻿ à́ b", "x" * 3000, "!!!'s'''ve", " \n\t"]


def test_op10_matches_the_library(spark, docs, empty, definition):
    rows = [tuple(r) for r in awkward()] + [(900 + i, t, None, None, None) for i, t in enumerate(HARD)]
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    library = op10_bpe.load(definition)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    for most in (op10_bpe.FREQUENT_WORDS, 5, 0):
        got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op10_bpe.digests(df, definition, most=most).collect()]
        assert sorted(got) == sorted(want)
    assert op10_bpe.digests(empty, definition).count() == 0


def test_op10_numbers_of_words_hold_few_objects(monkeypatch):
    words = [f"w{i:x}" for i in range(5000)]
    asked = words[::7] + ["none", "w", "\u00e4"] + words[::-3]
    want = [{w: i for i, w in enumerate(words, 1)}.get(w, 0) for w in asked]
    for hashing in (hash, len):  # with lengths as hashes, most words collide
        monkeypatch.setattr(op10_bpe, "hash", hashing, raising=False)
        numbers = op10_bpe.Numbers(pa.array(words), 100)
        assert numbers.of(asked).tolist() == want
        assert len(numbers.held) == 100
    assert op10_bpe.Numbers(pa.array([], pa.string())).of(["a"]).tolist() == [0]


def test_op10_encode_then_decode(spark, definition):
    df = spark.createDataFrame([(1, "Hello, wörld"), (2, None), (3, "")], "doc_id long, text string")
    encoded = op10_bpe.encode(df, definition)
    out = {r.doc_id: r.text for r in op10_bpe.decode(encoded, op10_bpe.pieces_table(spark, definition)).collect()}
    library = op10_bpe.load(definition)
    assert out == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in [(1, "Hello, wörld"), (2, ""), (3, "")]}


def test_frequent_words_are_counted_over_all_batches(spark):
    """A word that stands once in each of many batches is more frequent than one that stands twice in one of them."""
    texts = spark.createDataFrame([("spread",)] * 6 + [("twice twice",)], "text string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert [tuple(r) for r in op10_bpe.frequent_words(texts, 1).collect()] == [("spread", 6)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
