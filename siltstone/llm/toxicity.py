"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, replaces letters of other scripts that look like Latin ones
and digits or signs that stand for letters, and turns other ASCII signs into
spaces. Lexicon entries are word beginnings or whole words, weighted by log odds
in labelled texts, and matched at the start of words only. A match inside an
exception phrase, or in a word without any letter, does not count. The weights
found are added up, normalised by the text's length, and turned into a score by
a monotone curve fitted to labelled texts.

Cases: a null text counts as empty and has the score of a text without matches;
without toxic and other labels every score is the share of toxic ones (0 without
any label); repeated rows count as often; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.text import utf8

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝкмтвнгαοενρτυικχ", "aeopcyxijshdqwkmtbhraoevptuikx")
# Digits and signs that stand for letters. l, 1, | and ! meet i.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "!": "i", "l": "i"}
# Harmless uses of words that are insults elsewhere.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "class clown", "clown fish", "pond scum")
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_TABLE = bytes(ord(STANDS_FOR.get(chr(b), chr(b))) if chr(b) in STANDS_FOR or b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SHORTEST, LONGEST = 4, 8
LABELLED_ROWS = 200_000  # labels to learn from, at most; a bounded table, so that no text is shuffled
LEAST_SUPPORT, LEAST_SHARE, LEAST_ODDS, MOST_ENTRIES = 5, 0.003, 3.0, 5_000
BINS = 64


def plain(text: bytes | None) -> bytes:
    """Lower case, with look-alike letters replaced; digits still stand."""
    if not text:
        return b""
    if text.isascii():
        return text.lower()
    said = unicodedata.normalize("NFKC", text.decode("utf-8", "replace")) if any(x in text for x in (b"\xef", b"\xe2", b"\xc2", b"\xf0")) else text.decode("utf-8", "replace")
    said = said.lower()
    if any(x in text for x in (b"\xd0", b"\xd1", b"\xd2", b"\xd3", b"\xd4", b"\xce", b"\xcf")):
        said = said.translate(LOOKALIKES)
    return said.translate(_INVISIBLE).encode() if any(x in text for x in (b"\xe2\x80", b"\xe2\x81", b"\xc2\xad", b"\xef\xbb")) else said.encode()


def fold(said: bytes) -> bytes:
    """From plain(): one byte for each byte, so that positions stay."""
    return said.translate(_TABLE)


def entries(text: bytes | None) -> set[bytes]:
    """What a text could add to a lexicon: beginnings of its words, marked by a
    space in front, and its whole words, with spaces on both sides."""
    out: set[bytes] = set()
    for w in set(fold(plain(text)).split()):
        out.add(b" " + w + b" ")
        out.update(b" " + w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[bytes, float]
    exceptions: Sequence[str] = EXCEPTIONS
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            made = ahocorasick.Automaton()
            for phrase in self.exceptions:
                w = (b" " + b" ".join(fold(plain(phrase.encode())).split()) + b" ").decode("latin-1")
                made.add_word(w, (len(w), None))
            for entry, weight in self.weights.items():
                w = entry.decode("latin-1")
                made.add_word(w, (len(w), weight))
            if len(made):
                made.make_automaton()
            self._machine = made
        return self._machine

    def matches(self, text: bytes | None) -> list[tuple[int, float]]:
        """(start in the folded text, weight) of what counts; of several entries
        that start at a word, the heaviest."""
        said = plain(text)
        machine = self.machine()
        if not said or not len(machine):
            return []
        look, spared, best = " " + fold(said).decode("latin-1") + " ", [], {}
        for end, (size, weight) in machine.iter(look):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(weight, best.get(start, weight))
        spared.sort()
        out, k, reach = [], 0, -1
        for start, weight in sorted(best.items()):
            while k < len(spared) and spared[k][0] <= start:  # how far the exceptions go that began by now
                k, reach = k + 1, max(reach, spared[k][1])
            word = said[start : look.index(" ", start + 1) - 1]
            if any(chr(b).isalpha() or b >= 128 for b in word) and start >= reach:
                out.append((start, weight))
        return out

    def strength(self, text: bytes | None) -> float:
        """Weights found, added up and normalised by the length in words."""
        found = self.matches(text)
        if not found:
            return 0.0
        n = len(text.split())
        return math.log1p(sum(w for _, w in found) * (1 + 10 / math.sqrt(max(1, n))))


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Weights from labelled texts: entries that many toxic texts hold and others
    hardly do. More than LABELLED_ROWS labels are cut down to so many, by hash."""
    chosen = (labels if rows is None else labels.filter(rows)).select(F.col(id_col).alias("doc_id"), F.col(target).alias("label")).filter("label in (0, 1)")
    if chosen.count() > LABELLED_ROWS:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(LABELLED_ROWS)
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def counter(wanted: set[bytes] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for text in utf8(batch.column(0)):
                    own = entries(text)
                    found.update(own if wanted is None else own & wanted)
                    found[b""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.binary()), pa.array(list(found.values()), type=pa.int64())], names=["entry", "n"])

        return run

    def counts(label: int, wanted: set[bytes] | None) -> DataFrame:
        return known.filter(F.col("label") == label).select("text").mapInArrow(counter(wanted), "entry binary, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    toxic = counts(1, None).persist()
    total = toxic.filter(F.length("entry") == 0).collect()
    n_toxic = total[0]["n"] if total else 0
    least = max(LEAST_SUPPORT, LEAST_SHARE * n_toxic)
    often = {bytes(r["entry"]): r["n"] for r in toxic.filter((F.length("entry") > 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "entry").limit(20 * MOST_ENTRIES).collect()}
    toxic.unpersist()
    other = {bytes(r["entry"]): r["n"] for r in counts(0, set(often)).collect()}  # as many as are in often, at most
    n_other = other.get(b"", 0)
    if not n_toxic or not n_other:
        return Lexicon({})
    odds = {e: math.log((n + 0.5) / (n_toxic + 1)) - math.log((other.get(e, 0) + 0.5) / (n_other + 1)) for e, n in often.items()}
    weights: dict[bytes, float] = {}
    for e in sorted(odds, key=lambda e: (len(e), e)):
        if odds[e] >= LEAST_ODDS and not any(e[:n] in weights for n in range(SHORTEST + 1, len(e))):
            weights[e] = odds[e]
    strongest = sorted(weights, key=lambda e: (-weights[e] * often[e], e))[:MOST_ENTRIES]
    return Lexicon({e: weights[e] for e in strongest})


def strengths(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the strength of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.strength(t) for t in utf8(batch.column(1))], type=pa.float64())], names=["doc_id", "strength"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, strength double")


@dataclass
class Curve:
    """A monotone, piecewise linear map from strength to score."""

    x: list[float]
    y: list[float]

    def column(self, strength: Column) -> Column:
        out = F.lit(self.y[-1])
        for i in reversed(range(len(self.x) - 1)):
            a, b = self.x[i], self.x[i + 1]
            out = F.when(strength < b, self.y[i] + (strength - a) * ((self.y[i + 1] - self.y[i]) / (b - a))).otherwise(out)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def curve(strength: DataFrame, labels: DataFrame, target: str = "toxic", rows: Column | None = None, id_col: str = "doc_id") -> Curve:
    """Shares of toxic texts by bin of strength, made monotone by pooling."""
    chosen = labels if rows is None else labels.filter(rows)
    both = strength.join(chosen.select(F.col(id_col).alias("doc_id"), F.col(target).alias("label")).filter("label in (0, 1)"), "doc_id")
    slot = F.when(F.col("strength") <= 0, 0).otherwise(F.least(F.lit(BINS - 1), 1 + F.floor(F.col("strength") * 4)).cast("int"))
    bins = both.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("t"), F.avg("strength").alias("x")).orderBy("bin").collect()
    pools: list[list[float]] = []
    for r in bins:
        pools.append([r["n"], r["t"], r["x"] * r["n"]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, t, x = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + t, pools[-1][2] + x]
    if not pools:
        return Curve([0.0], [0.0])
    x, y = [p[2] / p[0] for p in pools], [(p[1] + 0.01) / (p[0] + 0.02) for p in pools]
    return Curve(x, y)
