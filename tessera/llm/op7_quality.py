"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document's measures go into one sketch for each (language, source): counts of
logarithmic bins, which merge by addition, give quantiles within a fixed relative error,
and come out the same in any order. A group's sketch is filled up with a few documents'
worth of its language's sketch and of that of all, so small groups need no rule of their
own. Fences set from the quartiles of that sketch, on the logarithmic scale, replace fixed
cutoffs; documents are joined with their group's fences and filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import stage

SYMBOLS = "#*$%&|<>"
#: Ratio of neighbouring bins: quantiles are within half a percent of a value of the group.
BIN_RATIO = 1.005
_LOG = float(np.log(BIN_RATIO))
#: Documents' worth that a language's sketch, and that of all, add to each group's.
PRIOR_DOCS = 50
#: Sketches are added in these parts of a document, in whole numbers.
_PARTS = 1_000_000
#: Measures, never zero: rates count one more than was seen, so that a short document without
#: a finding is not told apart from one with few. Quartiles of rates then follow a group's
#: lengths as well as what it holds.
MEASURES = {
    "symbols": "(n_symbols + 1) / cast(n_words + 1 as double)",
    "dup_lines": "(n_dup_lines + 1) / cast(n_words + 1 as double)",
    "repeats": "(n_repeat_words + 1) / cast(n_words + 1 as double)",
    "word_length": "greatest(word_chars, 1) / cast(greatest(n_words, 1) as double)",
}
#: Fences lie so many times the distance of a group's quartiles beyond them; only that of the
#: word length has a lower one.
SPREADS = {"symbols": 2, "dup_lines": 3, "repeats": 4, "word_length": 3}
TWO_SIDED = ("word_length",)
#: Quartiles count as so many bins apart at least (2.5 %), where nearly all values are one.
LEAST_SPREAD = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(text: str) -> tuple[int, int, int, int, int]:
    """``FEATURES`` of a whole text. Words are runs between ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return 0, 0, 0, 0, 0
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        number: dict[tuple, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), dtype=np.int64, count=len(windows))
        twice = np.bincount(ids)[ids] > 1
        inside = np.zeros(len(words), dtype=bool)
        for k in range(3):
            inside[k : k + len(twice)] |= twice
        repeated = int(inside.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` for every row; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column(3)]
            columns = [pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "lang", "source", *FEATURES])

    read = docs.select(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    return read.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{f} long" for f in FEATURES))


def bin_of(value: str) -> str:
    """SQL of a value's logarithmic bin, understood alike by Spark and DuckDB; values below a billionth share its bin."""
    return f"cast(floor(ln(greatest({value}, cast('1e-9' as double))) / cast('{_LOG!r}' as double)) as int)"


def sketches(rows: DataFrame, groups: list[str], values: dict[str, str]) -> DataFrame:
    """``(*groups, measure, bin, n)``: the log-bin sketch of each value expression in each group. Sketches of parts add up."""
    bins = [F.struct(F.lit(k).alias("measure"), F.expr(bin_of(v)).alias("bin")) for k, v in values.items()]
    return rows.select(*groups, F.inline(F.array(*bins))).groupBy(*groups, "measure", "bin").agg(F.count("*").alias("n"))


def filled(sketch: DataFrame) -> DataFrame:
    """Each (lang, source) sketch with ``PRIOR_DOCS`` documents' worth of its language's and of all added, in ``_PARTS``."""
    groups = sketch.select("lang", "source").distinct()
    upper = sketch.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    every = upper.groupBy("measure", "bin").agg(F.sum("n").alias("n"))

    def worth(counts: DataFrame, by: list[str]) -> DataFrame:
        whole = F.sum("n").over(Window.partitionBy(*by, "measure"))
        return counts.withColumn("whole", whole).select(*by, "measure", "bin", F.expr(f"n * {PRIOR_DOCS * _PARTS}L div whole").alias("w"))

    own = sketch.select("lang", "source", "measure", "bin", (F.col("n") * _PARTS).alias("w"))
    language = worth(upper, ["lang"]).withColumnRenamed("lang", "_lang")
    language = groups.join(language, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    measures = F.explode(F.array(*[F.lit(k) for k in MEASURES])).alias("measure")
    general = groups.select("lang", "source", measures).join(worth(every, []), "measure")
    parts = own.unionByName(language).unionByName(general)
    return parts.groupBy("lang", "source", "measure", "bin").agg(F.sum("w").alias("w"))


def fences(sketch: DataFrame) -> DataFrame:
    """``(lang, source, limits)``: by measure each group's fences ``low`` and ``high``, in bins, from its :func:`filled` sketch."""
    by = ["lang", "source", "measure"]
    up_to = F.sum("w").over(Window.partitionBy(*by).orderBy("bin"))
    read = sketch.select(*by, "bin", up_to.alias("up_to"), F.sum("w").over(Window.partitionBy(*by)).alias("whole"))
    quarter = [F.min(F.when(4 * F.col("up_to") >= k * F.col("whole"), F.col("bin"))).alias(f"q{k}") for k in (1, 3)]
    spreads = F.create_map(*[F.lit(x) for kv in SPREADS.items() for x in kv])
    beyond = F.element_at(spreads, F.col("measure")) * F.greatest(F.lit(LEAST_SPREAD), F.col("q3") - F.col("q1"))
    low = F.when(F.col("measure").isin(*TWO_SIDED), F.col("q1") - beyond)
    limit = F.struct(low.alias("low"), (F.col("q3") + beyond).alias("high"))
    limits = read.groupBy(*by).agg(*quarter).withColumn("limit", limit)
    return limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == k, F.col("limit"))).alias(k) for k in MEASURES])


def judge(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`measured` with ``base_failed`` and ``kept``.

    A document fails the base for fewer than 50 words, or with more than half of its words
    in repeated windows. One that passes is kept if no measure lies beyond the fences of
    its (language, source); null languages and sources form groups of their own. Fences are
    learnt from documents that pass the base. Repeated rows count and stay; empty and very
    long texts are measured like others. One count a group, measure and bin is shuffled.
    An empty table gives no rows.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    sketch = stage(sketches(rows.where(~F.col("base_failed")), ["lang", "source"], MEASURES), "sketch")
    own = fences(filled(sketch))
    joined = rows.alias("r").join(own.alias("own"), F.col("r.lang").eqNullSafe(F.col("own.lang")) & F.col("r.source").eqNullSafe(F.col("own.source")), "left")
    beyond = F.lit(False)
    for k, v in MEASURES.items():
        at = F.expr(bin_of(v))
        beyond = beyond | F.coalesce(at > F.col(f"own.{k}.high"), F.lit(False)) | F.coalesce(at < F.col(f"own.{k}.low"), F.lit(False))
    return joined.select("r.*", (~F.col("base_failed") & ~beyond).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` for every row of ``docs``."""
    return judge(stage(measured(docs), "quality")).select("doc_id", *FEATURES, "base_failed", "kept")


_WORD = r"[^\x20\x09-\x0D]"


def _worth_sql(table: str, by: str) -> str:
    return f"select {by}measure, bin, n * {PRIOR_DOCS * _PARTS} // sum(n) over (partition by {by}measure)::bigint as w from {table}"


def _cases(values: dict) -> str:
    return "case measure " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


ORACLE = f"""with t as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select r, unnest(words) as word, generate_subscripts(words, 1) as i from (select r, regexp_extract_all(text, '{_WORD}+') as words from t)),
n as (select r, count(*) as n_words, sum(length(word))::bigint as word_chars from w group by r),
g as (select r, i, count(*) over (partition by r, gram) as times from (select r, i, word || ' ' || lead(word, 1) over x || ' ' || lead(word, 2) over x as gram from w window x as (partition by r order by i)) where gram is not null),
rep as (select r, count(distinct spot) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as spot from g where times > 1) group by r),
l as (select r, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as line from t) where regexp_matches(line, '{_WORD}') group by r),
m as (select t.r, doc_id, lang, source, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from t left join n on n.r = t.r left join rep on rep.r = t.r left join l on l.r = t.r),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
x as (select r, lang, source, unnest([{", ".join(f"'{k}'" for k in MEASURES)}]) as measure, unnest([{", ".join(bin_of(v) for v in MEASURES.values())}]) as bin from b where not base_failed),
sketch as (select lang, source, measure, bin, count(*) as n from x group by all),
groups as (select distinct lang, source from sketch),
upper as (select lang, measure, bin, sum(n)::bigint as n from sketch group by all),
every as (select measure, bin, sum(n)::bigint as n from upper group by all),
parts as (select lang, source, measure, bin, n * {_PARTS} as w from sketch
  union all select g.lang, g.source, u.measure, u.bin, u.w from groups g join ({_worth_sql("upper", "lang, ")}) u on g.lang is not distinct from u.lang
  union all select g.lang, g.source, e.measure, e.bin, e.w from groups g cross join ({_worth_sql("every", "")}) e),
full_ as (select lang, source, measure, bin, sum(w)::bigint as w from parts group by all),
cum as (select lang, source, measure, bin, sum(w) over (partition by lang, source, measure order by bin) as up_to, sum(w) over (partition by lang, source, measure) as whole from full_),
q as (select lang, source, measure, min(bin) filter (where 4 * up_to >= whole) as q1, min(bin) filter (where 4 * up_to >= 3 * whole) as q3 from cum group by all),
f as (select lang, source, measure, q3 + {_cases(SPREADS)} * greatest({LEAST_SPREAD}, q3 - q1) as high, case when measure in ({", ".join(f"'{k}'" for k in TWO_SIDED)}) then q1 - {_cases(SPREADS)} * greatest({LEAST_SPREAD}, q3 - q1) end as low from q),
out_ as (select x.r, bool_or(x.bin > f.high or coalesce(x.bin < f.low, false)) as beyond from x join f on f.lang is not distinct from x.lang and f.source is not distinct from x.source and f.measure = x.measure group by x.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(beyond, false) as kept from b left join out_ using (r)"""
