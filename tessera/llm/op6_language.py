"""Language identification by cross-parsing entropy.

A suffix automaton for each language accepts every substring of its labelled text. A
document is parsed greedily into longest matches of that text; the language that needs
the fewest phrases, normalised by the length of its labelled text, wins.

Texts are parsed side by side in pieces. A piece begins as if a phrase began there; where
the piece before it ends inside a phrase, it is parsed again from that state until both
parses are in one state, from where on they agree. So the phrases are those of one
greedy parse of the whole text, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workers import trimmed
from tessera.plans.staging import stage

UNDETERMINED = "und"
#: Labelled documents from which a language is learnt at most, and all languages together.
SAMPLE_DOCS = 64
MODEL_DOCS = 1_024
#: Documents of at most so many characters are learnt from, each whole; a language that has none takes its shortest one.
LEARN_CHARS = 4_000
#: Bytes of a piece, rounds of stitching pieces side by side before the rest is parsed one by one, and characters
#: that are held at once. None of them changes a result.
_PIECE = 256
_ROUNDS = 6
_SLICE_CHARS = 1_000_000
_SOME = 1_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point for each letter, a blank for anything else."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalise(texts: list[str], after_blank: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with letters lower-cased and each other run a blank; each text's end there; its letters.

    ``after_blank`` tells that what comes before the first text ended with a blank, or that nothing does.
    """
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    mapped = _letters()[points]
    blank = mapped == 32
    kept = ~(blank & np.r_[after_blank, blank[:-1]])
    width = (1 + (mapped >= 0x80) + (mapped >= 0x800) + (mapped >= 0x10000)) * kept
    data = np.frombuffer(mapped[kept].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    letters = np.add.reduceat((~blank).astype(np.int64), np.r_[0, ends[:-1]])
    return data, np.cumsum(width)[ends - 1], letters


def suffix_automaton(data: bytes) -> tuple[list[dict[int, int]], int]:
    """Transitions of the automaton of all substrings of ``data``, by state, and the number of states; state 0 is the root."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[state] = copy
                while p != -1 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
        last = state
    return following, len(following)


class Automaton:
    """Transitions of one language's automaton, laid over one another in one array of 8 bytes a slot.

    A state is the place where its row of 256 slots begins, each state another; rows overlap where they do not
    collide. A slot holds the state it belongs to above and the one it leads to below; the root is 0.
    """

    def __init__(self, data: bytes) -> None:
        following, states = suffix_automaton(data)
        self.length = len(data)
        room = 2 * sum(map(len, following)) + 1024
        free, place, used, cursor = bytearray(b"\x01") * room, [0] * states, {0}, 0
        for b in following[0]:
            free[b] = 0
        rows = sorted(range(1, states), key=lambda i: -len(following[i]))
        degree = 0
        for i in rows:
            symbols = sorted(following[i])
            if not symbols:
                continue
            if len(symbols) != degree:
                degree, cursor = len(symbols), 0
            low, rest, at, tries = symbols[0], symbols[1:], cursor, 0
            while True:
                at = free.find(1, at)
                if at < 0:
                    at = len(free)
                    free += b"\x01" * room
                base = at - low
                if base > 0 and base not in used and all(free[base + b] for b in rest):
                    break
                at += 1
                tries += 1
            # Places that many rows did not fit into are not tried again by rows of this size.
            cursor = at if tries > 32 else cursor
            used.add(base)
            place[i] = base
            for b in symbols:
                free[base + b] = 0
            if base + 256 > len(free):
                free += b"\x01" * room
        size = len(free) + 512
        for i in rows:
            if not following[i]:
                size += 256
                place[i] = size - 256
        self.slots = np.full(size, -1, dtype=np.int64)
        for i, to in enumerate(following):
            for b, t in to.items():
                self.slots[place[i] + b] = place[i] << 32 | place[t]
        self.root = self.step(np.zeros(256, np.int64), np.arange(256, dtype=np.int64))
        self.unseen = self.root < 0
        self.begin = np.where(self.unseen, 0, self.root)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """States after one more byte; -1 where the match cannot go on."""
        held = self.slots[state + byte]
        return np.where(held >> 32 == state, held & 0xFFFFFFFF, -1)

    def parse(self, data: np.ndarray, state: int) -> tuple[int, int]:
        """Phrases that end in ``data``, and the state after it, by one walk."""
        slots, count, unseen, begin = self.slots, 0, self.unseen.tolist(), self.begin.tolist()
        for byte in data.tolist():
            held = int(slots[state + byte])
            if held >> 32 == state:
                state = held & 0xFFFFFFFF
            else:
                count += (state != 0) + unseen[byte]
                state = begin[byte]
        return count, state


def train(samples: dict[str, list[str]]) -> dict:
    """An automaton for each language whose texts hold letters; every text is learnt whole."""
    out = {}
    for lang in sorted(samples):
        data, _, letters = normalise(samples[lang] or [""])
        if letters.sum():
            out[lang] = Automaton(bytes(data))
    return out


def phrases(data: np.ndarray, ends: np.ndarray, automaton: Automaton, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many phrases end before its last byte's end, and the state there (0 if just no phrase is open).

    ``entry`` holds the states in which the texts begin (0 by default).
    """
    begins = np.r_[0, ends[:-1]]
    pieces = -(-(ends - begins) // _PIECE)
    owner = np.repeat(np.arange(len(ends)), pieces)
    first = np.cumsum(pieces) - pieces
    nth = np.arange(len(owner)) - np.repeat(first, pieces)
    start = begins[owner] + nth * _PIECE
    size = np.minimum(ends[owner] - start, _PIECE)
    entry = np.zeros(len(ends), np.int64) if entry is None else entry
    enters = np.zeros(len(owner), np.int64)
    enters[nth == 0] = entry[owner[nth == 0]]
    padded = np.r_[data.astype(np.int64), np.zeros(_PIECE, np.int64)]
    track = np.empty((_PIECE, len(owner)), np.int32)
    so_far = np.empty((_PIECE, len(owner)), np.int16)

    # Every piece, those that begin a text from its entry and others from the root.
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(_PIECE), "left")
    state, count = enters[order].copy(), np.zeros(len(owner), np.int16)
    at = start[order]
    for j in range(_PIECE):
        n = int(active[j])
        if not n:
            break
        c = padded[at[:n] + j]
        to = automaton.step(state[:n], c)
        stuck = to < 0
        # A phrase ends where no longer match goes on; a byte that the language lacks is one of its own.
        count[:n] += (stuck & (state[:n] != 0)).astype(np.int16) + (stuck & automaton.unseen[c])
        state[:n] = np.where(stuck, automaton.begin[c], to)
        track[j, :n], so_far[j, :n] = state[:n], count[:n]
    place = np.empty(len(owner), np.int64)
    place[order] = np.arange(len(owner))
    leaves, ended = state[place], count[place].astype(np.int64)
    whole, out = ended.copy(), leaves.copy()

    # Pieces that are entered inside a phrase, again until their states meet those of the first parse.
    for _ in range(_ROUNDS):
        came = np.r_[np.int64(0), leaves[:-1]]
        came[nth == 0] = enters[nth == 0]
        redo = np.flatnonzero(came != enters)
        if not len(redo):
            break
        enters[redo] = came[redo]
        redo = redo[np.argsort(-size[redo], kind="stable")]
        state, count = came[redo].copy(), np.zeros(len(redo), np.int64)
        for j in range(_PIECE):
            over = size[redo] <= j
            if over.any():
                leaves[redo[over]], ended[redo[over]] = state[over], count[over]
                redo, state, count = redo[~over], state[~over], count[~over]
            if not len(redo):
                break
            c = padded[start[redo] + j]
            to = automaton.step(state, c)
            stuck = to < 0
            count += (stuck & (state != 0)).astype(np.int64) + (stuck & automaton.unseen[c])
            state = np.where(stuck, automaton.begin[c], to)
            met = state == track[j, place[redo]]
            if met.any():
                same = redo[met]
                leaves[same], ended[same] = out[same], count[met] + whole[same] - so_far[j, place[same]]
                redo, state, count = redo[~met], state[~met], count[~met]
        leaves[redo], ended[redo] = state, count
    came = np.r_[np.int64(0), leaves[:-1]]
    came[nth == 0] = enters[nth == 0]
    for i in np.unique(owner[came != enters]):
        now = int(entry[i])
        for k in range(first[i], first[i] + pieces[i]):
            if now != enters[k]:
                enters[k] = now
                ended[k], leaves[k] = automaton.parse(data[start[k] : start[k] + size[k]], now)
            now = int(leaves[k])
    total = np.bincount(owner, weights=ended, minlength=len(ends)).astype(np.int64)
    final = entry.copy()
    full = pieces > 0
    final[full] = leaves[(first + pieces - 1)[full]]
    return total, final


def counted(texts: list[str], model: dict[str, Automaton]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases (texts by languages), bytes and letters of whole texts. Long texts are read in slices, with the states carried on."""
    count, letters, length = np.zeros((len(texts), len(model)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and chars + len(texts[j]) <= _SLICE_CHARS:
            chars += len(texts[j])
            j += 1
        if j > i:
            data, ends, letters[i:j] = normalise(texts[i:j])
            length[i:j] = np.diff(np.r_[0, ends])
            for k, automaton in enumerate(model.values()):
                ended, state = phrases(data, ends, automaton)
                count[i:j, k] = ended + (state != 0)
            i = j
            continue
        states, blank = [np.zeros(1, np.int64) for _ in model], True
        for s in range(0, len(texts[i]), _SLICE_CHARS):
            part = texts[i][s : s + _SLICE_CHARS]
            last = s + _SLICE_CHARS >= len(texts[i])
            data, ends, found = normalise([part], blank)
            if not last and len(data) and _letters()[ord(part[-1])] != 32:
                data, ends = data[:-1], ends - 1  # the blank that ends a text, not a slice
            blank = _letters()[ord(part[-1])] == 32
            letters[i] += found[0]
            length[i] += len(data)
            for k, automaton in enumerate(model.values()):
                ended, states[k] = phrases(data, ends, automaton, states[k])
                count[i, k] += ended[0]
        count[i] += [int(s[0] != 0) for s in states]
        i += 1
    return count, length, letters


def judge(texts: list[str | None], model: dict[str, Automaton]) -> tuple[list[str], list[float]]:
    """Language and score of each whole text. Ties go to the first language by code point; equal texts are parsed once."""
    if not model:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    number: dict[str, int] = {}
    which = [number.setdefault(t or "", len(number)) for t in texts]
    count, length, letters = counted(list(number), model)
    langs, sizes = list(model), np.array([max(a.length, 2) for a in model.values()])
    bits = count * np.log2(sizes) / np.maximum(length, 1)[:, None]
    best = bits.argmin(axis=1)
    share = np.exp2(bits.min(axis=1)[:, None] - bits)
    score = np.where(letters > 0, 1 / share.sum(axis=1), 0.0)
    named = [langs[b] if n else UNDETERMINED for b, n in zip(best, letters)]
    return [named[i] for i in which], score[which].tolist()


def held_out(doc_id, fold: int = 2, folds: int = 4) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo ``folds``, is ``fold``. Null ids are learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, model_docs: int = MODEL_DOCS, learn_chars: int = LEARN_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Automaton]:
    """An automaton a language, of at most ``sample_docs`` distinct texts, in hashed order, not held out, each learnt whole.

    With many languages each gets its share of ``model_docs``, one at least. Texts of more than ``learn_chars`` characters
    are not chosen, but for the shortest of a language that has no other. Hashes are thinned to about four times the sample by
    each language's count before they are ranked, so no task ranks a whole language. Null texts and languages are passed over.
    An empty table gives no automaton.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    text = F.col(text_col).cast("string")
    marked = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("h"), F.greatest(F.char_length(text), F.lit(learn_chars)).alias("size"))
    marked = stage(marked.distinct(), "text-hashes")
    counts = marked.groupBy("lang", (F.col("size") > learn_chars).alias("long")).agg(F.count("*").alias("n"), F.min(F.struct("size", "h")).alias("least"))
    counts = counts.groupBy("lang").agg(F.sum(F.when(~F.col("long"), F.col("n"))).alias("n"), F.min("least").alias("least")).cache()
    langs = counts.count()
    each = max(1, min(sample_docs, model_docs // max(langs, 1)))
    share = F.least(F.lit(1.0), F.lit(4.0 * each) / F.col("n"))
    thin = marked.where(F.col("size") == learn_chars).join(counts.where("n is not null").select("lang", "n"), "lang").where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < share * 1_000_000)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = thin.withColumn("r", rank).where(F.col("r") <= each).select("lang", "h")
    chosen = stage(chosen.unionByName(counts.where("n is null").select("lang", F.col("least.h").alias("h"))), "chosen")
    counts.unpersist()
    texts = known.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    # At most model_docs rows, or one a language; copies of a text are folded before they are sent.
    rows = texts.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return train(samples)


def identify(docs: DataFrame, model: dict[str, Automaton], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (all by default) with ``lang_pred`` and ``score``, by whole texts alone, moving no row.

    ``und`` with score 0 if the text is null, empty or has no letters, or if no language was
    learnt. Every row is judged on its own, repeated or not, and a text of any length as a whole. Columns of those names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    read = docs.select(*names, *[text_col] * (text_col not in names))
    at = read.columns.index(text_col)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in read.schema.fields[: len(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few texts at a time: as strings they take several times their size.
        for batch in (whole.slice(i, _SOME) for whole in batches for i in range(0, whole.num_rows, _SOME)):
            lang, score = judge(batch.column(at).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return read.mapInArrow(trimmed(run), f"{schema}, lang_pred string, score double")


def predict_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``; learns from the rows not held out."""
    judged = identify(docs, fit(docs), carry=["doc_id"])
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
