"""Licence scans: the Dice coefficient over word bigrams of normalised text and licence templates.

Texts become lower-case words (British and American spellings of licence made one).  A passage of s bigrams and
a template of n have at most the coefficient 2 * min(s, n) / (s + n), so only passages of sizes between
n * t / (2 - t) and n * (2 - t) / t can reach a threshold t; and such a passage needs enough bigrams of the
template.  Where too few stand close together the template is passed over without any comparison.  All other
passages that begin and end with a bigram of the template are compared in full; nothing else can be the best, as
cutting foreign bigrams off an end raises the coefficient.

Short statements differ in few words, so a passage counts only if its telling words (names such as "mit", "lesser" or
"sharealike", words of telling clauses such as "advertising", and version numbers) are those of the template; and a passage within a few words of a negation
before it in the same sentence ("not licensed under") does not count.

Licences share text, so of overlapping passages of different licences one stands: that which explains most, by the bigrams that
it shares with its template less those left over on both sides.  An SPDX expression ("MIT OR Apache-2.0", parentheses, WITH and an exception)
gives each of its licences, as if each had a tag of its own.

Defined results: a null text counts as empty; texts and templates without bigrams match nothing; each document and
licence gives one row, the best passage: the highest coefficient, then the first, then the shortest; a null doc_id and
repeated rows give rows of their own; empty input gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table
from .licence_templates import IDENTIFIERS, NEGATES_NOTHING, NEGATIONS, TELLING, TEMPLATES, VERSION_BEFORE

THRESHOLD = 0.8
CHUNK = 1 << 19
#: Words before a passage in which a negation undoes it.
NEGATED = 4
WORD = re.compile(r"\w+")
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "acknowledgment": "acknowledgement"}
#: What ends a sentence between a negation and a statement.
STOP = re.compile(r"[.!?;](\s|$)|\n\s*\n")
#: An SPDX tag with an expression of any length on its line.
TAG = re.compile(r"spdx-license-identifier:[ \t]*((?:[\w.+-]+|[()]|[ \t])+)", re.IGNORECASE)
KNOWN = {x.lower(): x.removesuffix("-only").removesuffix("-or-later") for x in IDENTIFIERS}


def expression(text: str) -> list[str]:
    """The known licences of an SPDX expression, in order; it ends where two names follow each other without AND, OR or WITH between."""
    out: list[str] = []
    before = "or"
    for token in re.findall(r"[\w.+-]+", text):
        low = token.lower()
        if low in ("and", "or", "with"):
            before = low
            continue
        if before is None:
            break
        if before != "with" and (name := KNOWN.get(low.rstrip("+.")) or KNOWN.get(low)):
            out.append(name)
        before = None
    return list(dict.fromkeys(out))


def words_of(text: str | None) -> list[str]:
    return [SPELLINGS.get(w, w) for w in WORD.findall((text or "").lower())]


def is_number(word: str) -> bool:
    """Digits, or digits behind a v."""
    return word[-1].isdigit() and (word.isdigit() or (word[0] == "v" and word[1:].isdigit()))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    def __init__(self, templates: list[tuple[str, str]], threshold: float, telling: tuple[str, ...] | None = None):
        """``telling``: words that tell licences apart, besides version numbers; None: any passage counts."""
        self.threshold, self.strict = threshold, telling is not None
        telling = telling or ()
        words = [(name, words_of(text)) for name, text in templates]
        words = [(name, w) for name, w in words if len(w) > 1]
        self.names = [name for name, _ in words]
        self.vocabulary = {w: n for n, w in enumerate(sorted({x for _, w in words for x in w} | {*NEGATIONS, *VERSION_BEFORE}))}
        # One number stands for all numbers that no template has; the last entry of the flags is for other words.
        self.other_number = len(self.vocabulary)
        self.span = len(self.vocabulary) + 2
        flag = lambda test: np.array([test(w) for w in self.vocabulary] + [False] * 2)
        self.number, self.versioned = flag(is_number), flag(lambda w: w in VERSION_BEFORE or w in telling or (w[0] == "v" and is_number(w)))
        self.tells, self.negates = flag(lambda w: w in telling or (w[0] == "v" and is_number(w))), flag(lambda w: w in NEGATIONS)
        self.number[self.other_number] = True
        ids = [np.array([self.vocabulary[x] for x in w], np.int64) for _, w in words]
        self.telling = [frozenset(x[self.telling_words(x)].tolist()) for x in ids]
        self.bigrams = [Counter((x[:-1] * self.span + x[1:]).tolist()) for x in ids]
        self.sorted = [np.array(sorted(b), np.int64) for b in self.bigrams]
        self.all = np.unique(np.concatenate([np.zeros(0, np.int64), *self.sorted]))

    def telling_words(self, flat: np.ndarray) -> np.ndarray:
        """Which words tell licences of a family apart; numbers do in a row behind a word that versions follow."""
        number = self.number[flat]
        tells = self.tells[flat]
        before = np.r_[False, self.versioned[flat][:-1]]
        for _ in range(3):
            tells = tells | (number & before)
            before = np.r_[False, (tells & number)[:-1]]
        return tells

    def word_id(self, word: str) -> int:
        """Of a word that the vocabulary does not have."""
        return self.other_number if is_number(word) else -1

    def scan(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its licences: (name, coefficient, first word, words)."""
        out: list[list[tuple]] = []
        held: list[np.ndarray] = []
        some: list[str] = []
        n = 0
        get = self.vocabulary.get
        stop = np.full(1, -1)
        for text in texts:
            low = (text or "").lower()
            ids = np.array([m if (m := get(SPELLINGS.get(w, w))) is not None else self.word_id(w) for w in WORD.findall(low)], np.int64)
            held += [ids, stop]
            some.append(low)
            n += len(ids)
            if n >= CHUNK:
                out += self._scan(held, some)
                held, some, n = [], [], 0
        return out + self._scan(held, some)

    def negated(self, text: str, words: np.ndarray, first: int) -> bool:
        """Whether a negation stands shortly before a word, in its sentence."""
        low = max(0, first - NEGATED)
        if not self.negates[words[low:first]].any():
            return False
        spans = [m.span() for m in WORD.finditer(text)][: first + 1]
        for i in range(low, first):
            word, after = text[slice(*spans[i])], text[slice(*spans[i + 1])]
            if word not in NEGATIONS or after in NEGATES_NOTHING.get(word, ()) or (word == "longer" and (not i or text[slice(*spans[i - 1])] != "no")):
                continue
            if not STOP.search(text[spans[i][1] : spans[first][0]]):
                return True
        return False

    def _scan(self, held: list[np.ndarray], texts: list[str]) -> list[list[tuple]]:
        if not held:
            return []
        flat = np.concatenate(held)
        ends = np.cumsum([len(x) for x in held])[1::2]
        known = (flat[:-1] >= 0) & (flat[1:] >= 0)
        places = np.flatnonzero(known)
        codes = flat[places] * self.span + flat[places + 1]
        mine = np.isin(codes, self.all)
        places, codes = places[mine], codes[mine]
        docs = np.searchsorted(ends, places, side="right")
        passages: list[list[tuple]] = [[] for _ in ends]
        tells = self.telling_words(flat)
        t = self.threshold
        for name, bigrams, its, telling in zip(self.names, self.bigrams, self.sorted, self.telling):
            size = bigrams.total()
            low, high = int(np.ceil(size * t / (2 - t) - 1e-9)), int(np.floor(size * (2 - t) / t + 1e-9))
            need = max(1, int(np.ceil(t * (low + size) / 2 - 1e-9)))
            on = np.isin(codes, its)
            at, code, doc = places[on], codes[on], docs[on]
            if len(at) < need:
                continue
            close = (at[need - 1 :] - at[: len(at) - need + 1] < high) & (doc[need - 1 :] == doc[: len(at) - need + 1])
            for i in np.flatnonzero(close).tolist():
                d, start = int(doc[i]), int(ends[doc[i] - 1]) if doc[i] else 0
                left, common, best = dict(bigrams), 0, None
                for j in range(i, len(at)):
                    s = int(at[j] - at[i]) + 1
                    if s > high or doc[j] != d:
                        break
                    if left.get(int(code[j]), 0):
                        left[int(code[j])] -= 1
                        common += 1
                    score = 2 * common / (s + size)
                    if s >= low and score >= t and (best is None or -score < best[0]):
                        if not self.strict or telling == set(flat[at[i] : at[i] + s + 1][tells[at[i] : at[i] + s + 1]].tolist()):
                            best = (-score, int(at[i]) - start, s, s + size - 3 * common, name)
                if best is not None and not self.negated(texts[d], flat[start : int(ends[d])], best[1]):
                    passages[d].append(best)
        return [self.licences(text, found) for text, found in zip(texts, passages)]

    def licences(self, text: str, passages: list[tuple]) -> list[tuple]:
        """The best passage of each licence; of overlapping ones of different licences that which leaves least over stands."""
        best: dict[str, tuple] = {}
        if passages and self.strict:
            owner = np.full(max(first + s + 1 for _, first, s, *_ in passages), -1)
            number = {n: i for i, n in enumerate(dict.fromkeys(self.names))}
            kept = []
            for p in sorted(passages, key=lambda p: (p[3], *p)):
                span = owner[p[1] : p[1] + p[2] + 1]
                if ((span < 0) | (span == number[p[4]])).all():
                    kept.append(p)
                    # One that runs on from a better passage of its licence claims nothing more.
                    if (span < 0).all():
                        span[:] = number[p[4]]
            passages = kept
        for score, first, s, _, name in passages:
            best[name] = min(best.get(name, (1,)), (score, first, s))
        for tag in TAG.finditer(text) if self.strict and "spdx" in text else ():
            names = expression(tag[1])
            first = len(WORD.findall(text[: tag.start()])) if len(names) > 1 else 0
            for name in names if len(names) > 1 else ():
                best[name] = min(best.get(name, (1,)), (-1.0, first, len(WORD.findall(tag[0])) - 1))
        return [(name, -score, first, s + 1) for name, (score, first, s) in sorted(best.items())]


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, telling: tuple[str, ...] | None = TELLING, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licence, dice, first_word, n_words) of the best passage for each document and licence."""
    schema = pa.schema([("doc_id", pa.int64()), ("licence", pa.string()), ("dice", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())])
    spark = docs.sparkSession
    # The templates are a fixed list, small whatever the corpus.
    sent = spark.sparkContext.broadcast(Templates(templates, threshold, telling))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = zip(batch.column(0).to_pylist(), sent.value.scan(batch.column(1).to_pylist()))
            yield from batches(((d, *x) for d, got in found for x in got), schema)

    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, licence string, dice double, first_word int, n_words int")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences found in all documents."""
    return scan_licences(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


QUERIES = {"op8_licence_scan": op8_licence_scan}
SQL: dict[str, str] = {}
