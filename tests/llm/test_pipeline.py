"""The pipeline's stages, one after the other, against what each may and may not do."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import op2_line_dedup, op3_mixing, op6_language, op10_bpe
from tessera.llm.queries import tokenizer_definition
from tests.llm.test_llm_operators import DOCS, awkward


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.createDataFrame(awkward(), DOCS).withColumn("shard", F.lit("extra"))
    out = []
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        step(spark, docs, "").write.parquet(path)
        out.append(docs)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_columns(steps):
    assert [set(d.columns) for d in steps[1:-1]] == [set(corpus_pipeline.COLUMNS)] * 4


def test_language_id_against_the_operator(steps):
    """Rows that stay are those with letters, and carry the language that a parse of the whole text finds."""
    model = op6_language.fit(steps[0])
    want = Counter()
    for r in steps[0].collect():
        if any(c.isalpha() for c in r.text or ""):
            want[r.doc_id, r.text, op6_language.judge([r.text], model)[0][0], r.source, r.n_chars] += 1
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in steps[1].collect()) == want


def test_line_dedup_against_brute_force(steps):
    before = steps[1].collect()
    pages, seen = Counter(r.source for r in before), Counter()
    for r in before:
        seen.update({(r.source, x.strip(" ")) for x in r.text.split("\n") if x.strip(" ")})
    drop = {k for k, n in seen.items() if n >= op2_line_dedup.MIN_PAGES and n > op2_line_dedup.RATIO * pages[k[0]]}
    want = Counter()
    for r in before:
        text = "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in drop)
        want[r.doc_id, text, r.lang, r.source, len(text)] += 1
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in steps[2].collect()) == want


def jaccard_groups(rows):
    """Components of ``(id, text)`` rows by five-word shingles, as lists of positions."""
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    part = list(range(len(rows)))

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or x and sets[j] and 10 * len(x & sets[j]) >= 8 * len(x | sets[j]):
                part[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    want = Counter(min((rows[i][0] is None, rows[i][0] or 0) for i in g) for g in jaccard_groups(rows))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in steps[3].collect()) == want


def test_near_dedup_keeps_rows_without_or_with_equal_ids(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 40 : i * 40 + 40]) for i in range(6)]
    rows = [(1, texts[0], "en", "a", 1), (1, texts[1], "en", "a", 1), (None, texts[2], "en", "a", 1), (None, texts[3], "en", "b", 1), (None, texts[3], "en", "a", 1), (2, texts[4], "en", "a", 1), (3, texts[4], "en", "a", 1), (None, texts[4], "en", "a", 1), (2, texts[5], "en", "a", 1)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((str(r.doc_id), r.text, r.source) for r in out) == sorted([("1", texts[0], "a"), ("1", texts[1], "a"), ("None", texts[2], "a"), ("None", texts[3], "a"), ("2", texts[4], "a"), ("2", texts[5], "a")])


def test_mix_takes_what_the_operator_counts(steps):
    counts = Counter()
    for r in op3_mixing.mix_documents(steps[3]).collect():
        counts[r.doc_id] += r.copies
    have = {(r.doc_id, r.text) for r in steps[3].collect()}
    taken = steps[4].collect()
    assert Counter(r.doc_id for r in taken) == +counts and max(counts.values()) <= 2 and all((r.doc_id, r.text) in have for r in taken)


def test_bpe_of_every_row(steps):
    library = op10_bpe.load(tokenizer_definition())
    want = Counter()
    for r in steps[4].collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        want[r.doc_id, len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in steps[5].collect()) == want


def test_run_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
