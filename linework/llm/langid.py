"""Language identification by cross-parsing: the language whose text explains a text in fewest phrases."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linework.llm.common import runs_of, with_text
from linework.sources.scratch import save

#: Learning is bounded: so many whole texts a language, of up to LONGEST characters where there are such, and so many languages.
SAMPLES, LONGEST, MOST_LANGS = 8, 8_000, 256
#: Codes: 0 a letter that no learned text has, 1 a run of anything but letters, 2 a mark between
#: samples that no text contains, then every learned letter by frequency.
MARK = 2
#: Codes below this have a column in the dense table of transitions; those of rarer letters are sparse.
DENSE = 64
#: Blocks of this many codes are parsed side by side.
BLOCK = 2048
UNKNOWN = "und"
RESULTS = ("lang_pred", "score")


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, str]:
    """A sample of whole texts per non-null language, the same for the same rows in any order.

    Texts are dealt by their hash into SAMPLES parts a language and each part gives one text: the least by hash of
    those of up to LONGEST characters, or the shortest where all are longer.  So copies count once,
    and what comes to the driver is SAMPLES texts a language at most, of the MOST_LANGS languages with the most rows.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    over = F.when(F.length("text") > LONGEST, F.length("text")).otherwise(0)
    least = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLES)).alias("part")).agg(F.min(F.struct(over.alias("over"), "h")).alias("least"), F.count("*").alias("n"))
    least = save(least.select("lang", "least.h", "n"), "language-samples")
    langs = least.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).select("lang")
    chosen = save(least.join(F.broadcast(langs), "lang").select("lang", "h"), "language-samples")
    once = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))  # SAMPLES rows a language at most
    found: dict[str, list] = {}
    for r in once.collect():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return {lang: "\0".join(s for _, s in sorted(rows)) for lang, rows in sorted(found.items())}


class Automaton:
    """Suffix automata of the learned languages as one: states are numbered through from 1; 0 is none, and leads nowhere.

    Transitions on codes below DENSE are a table (row state, column code), the others sorted keys
    state * letters + code; those from the starts are a table of all codes besides (row language).
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        points = np.arange(0x110000)
        self.letter = np.fromiter((chr(i).isalpha() for i in points), bool, len(points))
        fold = points.copy()
        for i in points[self.letter]:
            low = chr(i).lower()
            if len(low) == 1:
                fold[i] = ord(low)
        seen = Counter()
        for _, text in samples:
            at = np.frombuffer(text.encode("utf-32-le"), "<u4")
            seen.update(fold[at[self.letter[at]]].tolist())
        self.codes = MARK + 1 + len(seen)
        self.code = np.ones(0x110000, np.min_scalar_type(self.codes))
        self.code[self.letter] = 0
        for n, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
            self.code[c] = MARK + 1 + n
        self.code[self.letter] = self.code[fold[self.letter]]
        moves, self.starts, self.weight, at = [np.zeros((0, 3), np.int64)], [], [], 1
        for _, text in samples:
            codes = self.encode(text, keep_marks=True)
            states, found = _suffix_automaton(codes)
            moves.append(found + np.array([at, 0, at]))
            self.starts.append(at)
            self.weight.append(log2(max(2, len(codes))))
            at += states
        state, code, target = np.concatenate(moves).T
        self.wide = min(DENSE, self.codes)
        self.table = np.zeros((at, self.wide), np.int32)
        low = code < self.wide
        self.table[state[low], code[low]] = target[low]
        self.table = self.table.reshape(-1)
        self.first = np.zeros((len(samples), self.codes), np.int32)
        for n, start in enumerate(self.starts):
            self.first[n, code[state == start]] = target[state == start]
        keys = state[~low] * self.codes + code[~low]
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], target[~low][order].astype(np.int32)
        self.rare = dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True))

    def encode(self, text: str, keep_marks: bool = False) -> np.ndarray:
        """Codes of a text, each run of other characters than letters as one."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        codes = self.code[points]
        if keep_marks:
            codes[points == 0] = MARK
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
        return codes[keep]

    def _sparse(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.codes + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], 0)

    def has_letter(self, text: str) -> bool:
        return bool(self.letter[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language: greedy longest matches over the whole text.

        All blocks of all texts go code by code side by side, longest first, so that those still
        running are a prefix.  Each starts as if a phrase began there; then the few codes until that
        parse meets the one that comes over from the block before are walked again (_rejoin).
        """
        blocks = [(n, c[at : at + BLOCK]) for n, c in enumerate(coded) for at in range(0, len(c), BLOCK)]
        order = sorted(range(len(blocks)), key=lambda b: -len(blocks[b][1]))
        lengths = np.array([len(blocks[b][1]) for b in order])
        grid = np.zeros((lengths[0] if len(order) else 0, len(order)), self.code.dtype)
        for col, b in enumerate(order):
            grid[: lengths[col], col] = blocks[b][1]
        state = np.zeros((len(self.langs), len(order)), np.int32)
        count = np.zeros(state.shape, np.int64)
        running = len(order) - np.searchsorted(lengths[::-1], np.arange(1, len(grid) + 1))
        for row, n in zip(grid, running, strict=True):
            self._step(row[:n].astype(np.int32), state[:, :n], count[:, :n])
        column = np.empty(len(order), int)
        column[order] = np.arange(len(order))
        out = np.zeros((len(coded), len(self.langs)), np.int64)
        for lang in range(len(self.langs)):
            ends, held, before = state[lang].tolist(), count[lang].tolist(), (-1, 0)
            for b, (n, codes) in enumerate(blocks):
                end, extra = ends[column[b]], 0
                if n == before[0]:
                    extra, met = self._rejoin(codes, before[1], lang)
                    end = end if met is None else met
                out[n, lang] += held[column[b]] + extra
                before = n, end
        return out

    def _step(self, c: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """One code of each text: follow it, or begin a phrase with it.  One that a language lacks is a phrase alone."""
        again = self.first.take(c, axis=1)
        if len(self.keys):
            now = self.table.take(state * self.wide + np.where(c < self.wide, c, 0))
            lang, at = np.nonzero((c >= self.wide) & (again > 0))  # a letter that a language lacks leads nowhere
            now[lang, at] = self._sparse(state[lang, at], c[at])
        else:
            now = self.table.take(state * self.wide + c)
        lost = now == 0
        count += lost
        state[:] = np.where(lost, again, now)

    def _rejoin(self, codes: np.ndarray, state: int, lang: int) -> tuple[int, int | None]:
        """How many phrases more a block has if it is entered in that state, and the state at its end if
        that differs: both parses are walked until they are in one state."""
        table, first, rare, wide, letters = memoryview(self.table), self.first[lang], self.rare, self.wide, self.codes
        fresh, extra = 0, 0
        for at in range(0, len(codes), 64):
            for c in codes[at : at + 64].tolist():
                now, other = ((table[s * wide + c] for s in (state, fresh)) if c < wide else (rare.get(s * letters + c, 0) for s in (state, fresh)))
                if not now:
                    extra, now = extra + 1, int(first[c])
                if not other:
                    extra, other = extra - 1, int(first[c])
                if now == other:
                    return extra, None
                state, fresh = now, other
        return extra, state

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        coded = [self.encode(t) if t and self.has_letter(t) else None for t in texts]
        known = [c for c in coded if c is not None]
        if not self.langs or not known:
            return [(UNKNOWN, 0.0)] * len(texts)
        rates = self.phrases(known) * np.array(self.weight) / np.array([len(c) for c in known])[:, None]
        found = iter(rates)
        out = []
        for c in coded:
            if c is None:
                out.append((UNKNOWN, 0.0))
                continue
            r = next(found)
            best = int(r.argmin())
            second = float(np.delete(r, best).min()) if len(r) > 1 else float("inf")
            out.append((self.langs[best], second / (second + r[best]) if second < float("inf") else 1.0))
        return out


def _suffix_automaton(codes: np.ndarray) -> tuple[int, np.ndarray]:
    """The automaton that accepts every substring of codes; state 0 is the root.

    Its number of states and its (state, code, target) transitions, under three a code.
    """
    nxt, link, longest, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        new = len(nxt)
        nxt.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return len(nxt), np.array([(s, c, t) for s, row in enumerate(nxt) for c, t in row.items()], np.int64).reshape(-1, 3)


@lru_cache(maxsize=1)
def automaton(samples: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(samples)


def _predictor(samples: tuple[tuple[str, str], ...], kept: list[str], texts: Callable[[pa.RecordBatch], pa.Array]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = automaton(samples)
        for batch in batches:
            for at, end in runs_of(texts(batch)):
                part = batch.slice(at, end - at)
                langs, scores = zip(*model.predict(texts(part).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, *RESULTS])

    return predict


def identify(docs: DataFrame, samples: dict[str, str], columns: list[Column], text_col: str = "text", text_in: str | None = None) -> DataFrame:
    """columns of docs, then lang_pred and score, from whole texts.

    A language's rate is its phrases times log2 of its learned length, over the text's length; the
    least rate wins (the first language by name on ties).  score is the second rate's share of the
    two: 0.5 for a tie, up to 1.  Null texts and those without a letter are 'und' with score 0, and
    all are if nothing was learned.  Of columns, those named like a column of the result give way to
    it; others of docs are ignored.  text_in: a struct among columns that has the text.  Repeated rows
    and empty tables pass through.
    """
    rows, kept, texts = with_text(docs, columns, text_col, RESULTS, text_in)
    fields = [*rows.schema.fields[: len(kept)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(_predictor(tuple(samples.items()), kept, texts), T.StructType(fields))
