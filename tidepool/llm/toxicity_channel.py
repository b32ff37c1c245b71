"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all texts (one pass; at most the cube
   of a small alphabet comes back as rows).
2. A word that may be written in disguise (digits and signs among or beside letters,
   a letter twice or more in a row, dots or dashes inside, letters spaced out)
   becomes a lattice: every character stands for itself or for the letters it
   imitates, repeats may shrink, separators and signs at the edges may vanish.  Viterbi decoding under the trigram
   model restores the likeliest text.  A word with letters only has one path, itself.
3. A linear model scores the restored text: each distinct word and its beginnings
   vote, and so does a restored word as it was written.  It is fitted on a bounded sample of labelled rows.

Scoring is one narrow pass; model and trigram table are fixed-size and travel with
the tasks.  Distinct words are decoded once while they stay in a bounded cache.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidepool.llm.byte_bpe import PieceCache
from tidepool.llm.common import cut_lineage, id_and_text

#: Letters of the character model: 0 is any non-letter, 1-26 a-z, then Latin small
#: letters with marks, last any other letter.
_MARKED = [c for c in range(0xDF, 0x100) if c != 0xF7]
OTHER = 27 + len(_MARKED)
LETTERS = OTHER + 1
_CODE = np.zeros(0x250, dtype=np.int64)
_CODE[ord("a"):ord("z") + 1] = np.arange(1, 27)
_CODE[_MARKED] = np.arange(27, OTHER)
_CODE[[c for c in range(0x250) if chr(c).isalpha() and chr(c).islower() and _CODE[c] == 0]] = OTHER

# What a sign may stand for; fixed values of the channel.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l",
}
SEPARATORS = ".-_ *~'`"
# Costs in nats: a sign read as a letter, a sign kept, a separator dropped or kept,
# a repeat dropped, a second letter of three or more kept.
C_IMITATE, C_KEEP_SIGN, C_DROP_SEP, C_KEEP_SEP, C_DROP_REPEAT, C_KEEP_TWO = 0.7, 9.0, 0.7, 2.0, 0.2, 1.2
# Costs of dropping one or two equal signs at a word's edge, by how seldom they stand
# there in plain text (a closing ! or a hashtag's # is as cheap as a separator, three
# or more in a row are an ornament).
C_DROP_EDGE = {"(": 4.0, "|": 7.0, "#": 4.5, "+": 4.0, "$": 12.0, "*": 3.0}
#: Features kept, labelled rows fitted on (at most), labelled rows of class 1 a feature needs.
KEPT, SAMPLE_LABELS, MIN_ROWS = 4096, 10_000, 4
#: Lengths of the beginnings that are features, and what marks them (no word holds it).
PREFIXES, START = (5, 6, 7), "\t"


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], OTHER)


def count_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) over all texts, boundaries included; gram is a code in base LETTERS."""

    def count(it):
        total = np.zeros(LETTERS ** 3, dtype=np.int64)
        for b in it:
            for t in b.column(0).to_pylist():
                if t:
                    c = np.concatenate([[0, 0], codes(t), [0]])
                    np.add.at(total, (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Channel:
    """The trigram model's costs and the decoder."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(LETTERS, LETTERS, LETTERS).astype(np.float64)
        bi, uni = n.sum(axis=0), n.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + LETTERS)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (n + 5 * p2) / (n.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).astype(np.float32)

    def __getstate__(self):
        return {"cost": self.cost}

    @cached_property
    def _flat(self) -> list[float]:
        return self.cost.ravel().tolist()

    @cached_property
    def _repeats(self) -> dict[str, str]:
        return {}

    def restore_letters(self, word: str) -> str:
        """restore() of a lower-case word with letters only.  All readings of a repeated
        letter end in the same state two letters further on, so the best one follows
        from the two letters before and behind it, and is looked up.  Repeats closer
        together than that are decoded with the whole word."""
        out, at, known = [], 0, self._repeats
        for m in _REPEAT.finditer(word):
            i, j = m.span()
            if out and i - at < 2:
                return self.restore(word)
            before, behind = word[max(0, i - 2):i], word[j:j + 2]
            run = word[i] * min(j - i, 3)
            key = f"{before} {run} {behind}"
            reading = known.get(key)
            if reading is None:
                whole = self.restore(before + run + behind)
                reading = whole[len(before):len(whole) - len(behind)]
                if len(known) < KNOWN_REPEATS:
                    known[key] = reading
            out += [word[at:i], reading]
            at = j
        return "".join([*out, word[at:]])

    def restore(self, word: str, left: int = 0, right: int = 0) -> str:
        """The likeliest plain text of a lower-case string, words split by spaces; of
        its signs the first ``left`` and the last ``right`` are edge signs."""
        cost = self._flat
        # state: the last two codes -> (cost, text as linked parts)
        beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        at = 0
        while at < len(word):
            if len(beam) == 1 and (m := _STRETCH.match(word, at)) and m[0].isalpha():
                # One path and one reading: what it costs is the same for every end.
                ((state, (so_far, parts)),) = beam.items()
                x, y = (*state, *[code_of(ch) for ch in m[0][-2:]])[-2:]
                beam, at = {(x, y): (so_far, (parts, m[0]))}, m.end()
                continue
            i, at = at, _RUN.match(word, at).end()
            c, n, end = word[i], at - i, at
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            edge = 1 if i < left else 2 if end > len(word) - right else 0
            for text, price, zs in _options(c, n, edge):
                for (a, b), (so_far, parts) in beam.items():
                    total, x, y = so_far + price, a, b
                    for z in zs:
                        if z or y:
                            total += cost[(x * LETTERS + y) * LETTERS + z]
                        x, y = y, z
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, (parts, text) if text else parts)
            beam = new
        best = min(beam.items(), key=lambda s: s[1][0] + cost[(s[0][0] * LETTERS + s[0][1]) * LETTERS])[1][1]
        out = []
        while best:
            best, text = best
            out.append(text)
        return " ".join("".join(reversed(out)).split())


@lru_cache(4096)
def code_of(ch: str) -> int:
    point = ord(ch)
    return int(_CODE[point]) if point < 0x250 else OTHER


_RUN = re.compile(r"(.)\1*", re.DOTALL)
_REPEAT = re.compile(r"([^\W\d_])\1+")
#: Repeated letters with their neighbours whose reading is kept.
KNOWN_REPEATS = 50_000
#: Letters of which none stands twice.
_STRETCH = re.compile(r"(?:([^\W\d_])(?!\1))+")


def _runs(word: str) -> list[tuple[int, int]]:
    out, i = [], 0
    while i < len(word):
        j = i + 1
        while j < len(word) and word[j] == word[i]:
            j += 1
        out.append((i, j))
        i = j
    return out


def _readings(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n equal characters may stand for, and at which cost."""
    if c.isalpha():
        if n == 1:
            return [(c, 0.0)]
        if n == 2:
            return [(c * 2, 0.0), (c, C_KEEP_TWO + 2 * C_DROP_REPEAT)]
        return [(c, C_DROP_REPEAT), (c * 2, C_KEEP_TWO)]
    out = []
    if c in IMITATES:
        for letter in IMITATES[c]:
            out.append((letter, C_IMITATE + (C_DROP_REPEAT if n > 1 else 0.0)))
            if n > 1:
                out.append((letter * 2, 2 * C_IMITATE))
    if c in SEPARATORS:
        out += [("", C_DROP_SEP), (" ", C_KEEP_SEP)]
    else:
        out.append((" ", C_KEEP_SIGN if c in IMITATES else C_KEEP_SEP))
    return out


def _edge_readings(c: str, n: int, front: bool) -> list[tuple[str, float]]:
    """As _readings, for a run at a word's edge: it may also be no part of the word."""
    letters = [r for r in _readings(c, n) if r[0].strip()]
    plain = n > 2 or (front and c == "#")
    return [*letters, ("", C_DROP_SEP if plain else C_DROP_EDGE.get(c, C_DROP_SEP))]


@lru_cache(4096)
def _options(c: str, n: int, edge: int) -> list[tuple[str, float, list[int]]]:
    """The readings of a run inside (0), at the front (1) or at the end (2), with codes."""
    readings = _edge_readings(c, n, edge == 1) if edge else _readings(c, n)
    return [(text, price, [code_of(ch) for ch in text]) for text, price in readings]


_TRIM_LEFT = " \t\n\r\v\f\"'([{<#*-.,;:~_`>|"
_TRIM_RIGHT = " \t\n\r\v\f\"')]}>.,;:!?#*-%&$+~_`|"
_TWICE = re.compile(r"([^\W\d_])\1")
_INSIDE = re.compile(r"[^\W\d_]")
#: Single letters with one to three signs or white spaces between them.
_SPACED = re.compile(r"(?<!\w)[^\W_](?:[\s.\-_*]{1,3}[^\W_]){2,}(?!\w)")


def core_and_edges(word: str) -> tuple[str, int, int]:
    """A lower-case word without what surrounds it, and how many signs at its front
    and at its end may be letters of it: those beside it that imitate letters and
    are no pair around it."""
    if word.isalpha():
        return word, 0, 0
    rest = word.lstrip(_TRIM_LEFT)
    core = rest.rstrip(_TRIM_RIGHT)
    if not core:
        return "", 0, 0
    before, after = word[:len(word) - len(rest)], rest[len(core):]
    left, right = len(before), 0
    while left and before[left - 1] in IMITATES:
        left -= 1
    while right < len(after) and after[right] in IMITATES:
        right += 1
    front, end = before[left:], after[:right]
    if front and front == end[::-1]:
        front = end = ""
    elif front == "(" and ")" in after:
        front = ""
    return front + core + end, len(front), len(end)


def in_disguise(core: str) -> bool:
    """Whether a trimmed lower-case word is written with anything but plain letters
    (words without any letter are numbers), or with a letter twice in a row."""
    if core.isalpha():
        return _TWICE.search(core) is not None
    return _INSIDE.search(core) is not None


def features_of(plain: str) -> list[str]:
    """Features of a restored word: itself and, each behind a START, its beginnings."""
    return [plain, *[START + plain[:n] for n in PREFIXES if len(plain) >= n]]


class Reader:
    """Distinct words of a text to restored words, cached."""

    def __init__(self, channel: Channel):
        self.channel = channel
        self.plain = PieceCache(self._plain, limit=50_000)
        self.read = PieceCache(self.forms, limit=50_000)

    def _plain(self, word: str) -> tuple[str, ...]:
        return self._both(word)[0]

    def forms(self, word: str) -> tuple[str, ...]:
        """The restored words and, where it differs, the word as written without edge
        signs: a doubled letter or a digit may well be meant (good, 1990s)."""
        plain, written = self._both(word)
        return plain if not written or written in plain else (*plain, written)

    def _both(self, word: str) -> tuple[tuple[str, ...], str]:
        core, left, right = core_and_edges(word.lower())
        if not core:
            return (), ""
        written = core[left:len(core) - right]
        if core.isalpha():
            return (self.channel.restore_letters(core),) if _TWICE.search(core) else (core,), written
        if in_disguise(core):
            return tuple(self.channel.restore(core, left, right).split()), written
        return (written,), written

    def spaced(self, text: str) -> list[str]:
        """Restored words of letters spaced out over several words of the text."""
        parts = [m[0].lower().split() for m in _SPACED.finditer(text)]
        return [w for p in parts if len(p) > 1 for w in self.channel.restore(" ".join(p)).split()]


@dataclass
class Model:
    """``weights``: feature (a word, or START and a beginning) -> weight."""

    channel: Channel
    bias: float
    weights: dict[str, float]

    def __post_init__(self):
        self.reader = Reader(self.channel)
        self.votes = PieceCache(self._vote)
        self.words = {f: w for f, w in self.weights.items() if not f.startswith(START)}
        self.starts = {f[1:]: w for f, w in self.weights.items() if f.startswith(START)}

    def __getstate__(self):
        return {"channel": self.channel, "bias": self.bias, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _weigh(self, plain: str) -> float:
        total, starts = self.words.get(plain, 0.0), self.starts
        for n in PREFIXES:
            if len(plain) < n:
                break
            total += starts.get(plain[:n], 0.0)
        return total

    def _vote(self, word: str) -> float:
        low = word.lower()
        if low.isalpha() and not _TWICE.search(low):  # one reading, itself
            return self._weigh(low)
        return sum([self._weigh(p) for p in self.reader.forms(word)])

    def score(self, text: str | None) -> float:
        """Probability of label 1; the bias alone for a text without words."""
        text = text or ""
        words = set(text.split())
        get = self.votes.__getitem__
        total = self.bias + sum([get(w) for w in words]) + sum(self._weigh(p) for p in set(self.reader.spaced(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    def forget(self) -> None:
        """Drops the known words; they would stay in memory as long as the cycles that the
        model and its tables form."""
        for known in (self.votes, self.reader.plain, self.reader.read, self.channel._repeats):
            known.clear()
        for known in (self.votes, self.reader.plain, self.reader.read):
            known.old = {}

    def restored(self, text: str | None) -> str:
        """The text's words as they are scored (for inspection)."""
        text = text or ""
        return " ".join([p for w in text.split() for p in self.reader.plain[w]] + self.reader.spaced(text))


def is_held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from; a null id counts as held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", label_col: str = "toxic", sample_labels: int = SAMPLE_LABELS) -> Model:
    """Character model over all texts; classifier on at most ``sample_labels``
    labelled rows (the first by a seeded hash of the id) outside the held-out fold.

    An id labelled more than once counts as 1 if any label says so; null labels and
    ids are left out.  Without rows of both labels every score is the smoothed share
    of label 1.
    """
    counts = np.zeros(LETTERS ** 3, dtype=np.int64)
    for gram, n in count_trigrams(docs, text_col).collect():  # at most LETTERS ** 3 rows
        counts[gram] = n
    channel = Channel(counts)
    known = labels.select(F.col(label_id).alias("l_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("l_id").isNotNull() & F.col("y").isNotNull() & ~is_held_out(F.col("l_id")))
    known = known.groupBy("l_id").agg((F.max("y") > 0).cast("int").alias("y"))
    few = cut_lineage(known.orderBy(F.xxhash64(F.lit(7), "l_id"), "l_id").limit(sample_labels))
    rows = id_and_text(docs, id_col, text_col)
    # At most ``sample_labels`` short rows: a bound, so the texts need no shuffle.
    labelled = rows.join(F.broadcast(few), F.col("doc_id") == F.col("l_id")).select("y", "text")

    def features(it):
        reader = Reader(channel)
        for b in it:
            out = []
            for t in b.column(1).to_pylist():
                t, seen = t or "", set()
                for w in set(t.split()):
                    for p in reader.read[w]:
                        seen.update(features_of(p))
                for p in set(reader.spaced(t)):
                    seen.update(features_of(p))
                out.append(list(seen))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["y", "held"])

    seen = cut_lineage(labelled.mapInArrow(features, "y int, held array<string>"))
    totals = dict(seen.groupBy("y").count().collect())
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    prior = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -3.0
    if not n1 or not n0:
        return Model(channel, prior, {})
    in1, in0 = F.sum("y"), F.count("*") - F.sum("y")
    odds = F.log((in1 + 0.5) / (n1 - in1 + 0.5)) - F.log((in0 + 0.5) / (n0 - in0 + 0.5))
    spread = F.sqrt(1 / (in1 + 0.5) + 1 / (in0 + 0.5))
    chosen = (seen.select("y", F.explode("held").alias("feature")).groupBy("feature")
              .agg(in1.alias("in1"), (odds / spread).alias("z"))
              .where((F.col("in1") >= MIN_ROWS) & (F.col("z") > 3))
              .orderBy(F.col("z").desc(), "feature").limit(KEPT).collect())
    if not chosen:
        return Model(channel, prior, {})
    names = [r.feature for r in chosen]
    keep = F.array_intersect("held", F.array(*[F.lit(f) for f in names])).alias("held")
    sample = seen.select("y", keep).collect()  # at most sample_labels rows of few features
    return Model(channel, *_fit(names, sample, prior))


def _fit(names: list[str], sample: list, prior: float) -> tuple[float, dict[str, float]]:
    """Logistic regression on the chosen features with an L2 penalty, by gradient
    descent with momentum; deterministic."""
    column = {f: i for i, f in enumerate(names)}
    rows, cols, y = [], [], np.array([r.y for r in sample], dtype=np.float64)
    for i, r in enumerate(sample):
        rows += [i] * len(r.held)
        cols += [column[f] for f in sorted(r.held)]
    rows, cols = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
    w, b, vw, vb = np.zeros(len(names)), prior, np.zeros(len(names)), 0.0
    # Scale by how often a feature stands, so rare and frequent ones learn alike.
    rate = 0.5 / np.sqrt(np.bincount(cols, minlength=len(names)) + 1.0)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], minlength=len(y)), -30, 30)))
        err = p - y
        vw = 0.9 * vw - rate * (np.bincount(cols, err[rows], minlength=len(names)) * 0.1 + 0.02 * w)
        vb = 0.9 * vb - 0.05 * err.mean() * 10
        w, b = w + vw, b + vb
    return float(b), {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-6}


def score_column(text: Column, model: Model) -> Column:
    """Probability of label 1 of each text; null counts as empty."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series([model.score(t) for t in texts], dtype="float64")
        finally:
            model.forget()   # the worker goes on to other tasks, with a model of their own

    return score(text.cast("string"))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row; null and empty texts get
    the model's bias, ids, nulls and repeats are carried as they are."""
    rows = id_and_text(docs, id_col, text_col).withColumn("score", score_column(F.col("text"), model))
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
