"""Language identification: known words first, character n-grams for the rest.

A word the model knows scores its log frequency in each language. An unseen word backs off to
its character n-grams, longest first: the first length at which any n-gram is known decides, and
if none is, the word says nothing. The model is fitted on a bounded sample of labelled texts and
kept to the most frequent entries of each language, so its size does not grow with the corpus;
every text is scored whole.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import accumulate, chain
from operator import methodcaller

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the fit: labelled texts taken per language (those with the smallest id digests),
#: and words and n-grams of each length kept per language (the most frequent).
SAMPLE_PER_LANGUAGE = 2000
WORDS_PER_LANGUAGE = 20_000
GRAMS_PER_LANGUAGE = 5_000
LONGEST_GRAM = 5
#: Evidence counts for at most so many words, and an unseen word for a part of a known one.
FULL_EVIDENCE = 50
BACKOFF_WEIGHT = 0.5
KNOWN_TOKENS = 200_000
TEXTS_AT_ONCE = 200
UNDETERMINED = "und"

plain = methodcaller("as_py")
_LETTERS = regex.compile(r"\p{L}+")                 # as in the fit; numerals are no letters


@dataclass
class Model:
    languages: list[str]
    words: dict[str, list[float]] = field(default_factory=dict)
    grams: list[dict[str, list[float]]] = field(default_factory=list)   # by length, from 1


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a sample of the rows with text, language and id that are not held out."""
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
                .filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~is_held_out("id")))
    chosen = (rows.select("lang", "id", F.xxhash64("id").alias("order"))
                  .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order", "id")))
                  .filter(F.col("n") <= per_language).select("lang", "id").distinct())
    sample = rows.join(chosen, ["lang", "id"], "left_semi")
    counts = (sample.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("w"))
                    .groupBy("lang", "w").count())
    padded = F.concat(F.lit(" "), "w", F.lit(" "))
    grams = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(F.lit(LONGEST_GRAM), F.length(padded))),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, n)))))
    entries = (counts.select("lang", F.lit(0).alias("n"), F.col("w").alias("e"), "count")
               .unionByName(counts.select("lang", grams.alias("e"), "count").groupBy("lang", "e").agg(F.sum("count").alias("count"))
                                  .select("lang", F.length("e").alias("n"), "e", "count")))
    top = Window.partitionBy("lang", "n").orderBy(F.desc("count"), "e")
    kept = (entries.withColumn("total", F.sum("count").over(Window.partitionBy("lang", "n")))
                   .withColumn("place", F.row_number().over(top))
                   .filter(F.col("place") <= F.when(F.col("n") == 0, WORDS_PER_LANGUAGE).otherwise(GRAMS_PER_LANGUAGE)))
    got = kept.select("lang", "n", "e", "count", "total").collect()   # bounded by the constants above
    languages = sorted({r.lang for r in got})
    place = {x: i for i, x in enumerate(languages)}
    totals = {(r.lang, r.n): r.total for r in got}
    model = Model(languages, {}, [{} for _ in range(LONGEST_GRAM)])
    tables = [model.words, *model.grams]
    floors = [[math.log(0.5 / (totals.get((x, n), 0) + 1)) for x in languages] for n in range(LONGEST_GRAM + 1)]
    for r in got:
        tables[r.n].setdefault(r.e, floors[r.n][:])[place[r.lang]] = math.log(r["count"] / (r.total + 1))
    return model


class Predictor:
    """(language, score) of texts; remembers the scores of a bounded number of tokens."""

    def __init__(self, model: Model):
        import numpy as np
        self.languages = model.languages
        tables = [model.words, *model.grams]
        self.entries = np.array([x for t in tables for x in t.values()]).reshape(sum(map(len, tables)), len(self.languages))
        ends = list(accumulate(map(len, tables)))
        self.words, *self.grams = [dict(zip(t, range(end - len(t), end))) for t, end in zip(tables, ends)]
        self._forget()

    def entries_for(self, word: str) -> list[int]:
        """The entries that score a word, whose mean counts: its own, or its n-grams of the first
        length, from the longest, at which any is known."""
        own = self.words.get(word)
        if own is not None:
            return [own]
        padded = f" {word} "
        for n in range(min(len(self.grams), len(padded)), 0, -1):
            get = self.grams[n - 1].get
            found = [e for i in range(len(padded) - n + 1) if (e := get(padded[i:i + n])) is not None]
            if found:
                return found
        return []

    def word_scores(self, words: list[str]):
        """An array of scores, one row per word; zero for a word that says nothing."""
        import numpy as np
        found = [self.entries_for(w) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        out, some = np.zeros((len(words), len(self.languages))), np.flatnonzero(counts)
        if len(some):
            starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
            weight = np.where(flat[starts] < len(self.words), 1.0, BACKOFF_WEIGHT) / counts[some]
            out[some] = np.add.reduceat(self.entries[flat], starts, axis=0) * weight[:, None]
        return out

    def _forget(self):
        import numpy as np
        self.known: dict[str, int] = {}
        self.table = np.zeros((4096, len(self.languages) + 1))

    def _learn(self, tokens: list[str]):
        """Rows of summed word scores and word counts; words are the runs of letters in a token."""
        import numpy as np
        first = len(self.known)
        words = [[low] if (low := t.lower()).isalpha() else _LETTERS.findall(low) for t in tokens]
        different = list({w for ws in words for w in ws})
        place = dict(zip(different, range(len(different))))
        scores = self.word_scores(different)
        owner = np.repeat(np.arange(len(tokens)), [len(ws) for ws in words])
        rows = np.zeros((len(tokens), self.table.shape[1]))
        np.add.at(rows[:, :-1], owner, scores[[place[w] for ws in words for w in ws]])
        rows[:, -1] = np.bincount(owner, minlength=len(tokens))
        while first + len(tokens) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[first:first + len(tokens)] = rows
        self.known.update(zip(tokens, range(first, first + len(tokens))))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        import numpy as np
        languages = self.languages
        if not languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        cut = [(t or "").split() for t in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            self._learn(list(new))
        out = []
        for tokens in cut:
            total = self.table[np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))].sum(axis=0)
            n = total[-1]
            if not n:
                out.append((UNDETERMINED, 0.0))
                continue
            odds = total[:-1] * (min(n, FULL_EVIDENCE) / n)
            p = np.exp(odds - odds.max())
            best = int(np.argmax(p))                       # ties: the first language in order
            out.append((languages[best], float(min(1.0, p[best] / p.sum()))))
        if len(self.known) > KNOWN_TOKENS:
            self._forget()
        return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of each row (all by default) with ``lang_pred`` and ``score``. A text that is
    null or has no letter, or a model without languages, gives ``und`` and 0; a text with letters
    of which the model knows none gets the first language and an even score. Repeated rows are
    scored each by itself; columns of the new names are replaced. ``text_col`` may be a field of a kept
    column (``row.text``); a text that is kept anyway goes to the tasks once."""
    keep = [c for c in (columns or docs.columns) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    path = text_col.split(".")
    kept = path[0] in keep

    def run(batches):
        import pyarrow.compute as pc
        predict = Predictor(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                b = batch.slice(at, TEXTS_AT_ONCE)
                texts = pc.struct_field(b.column(0), path) if kept else b.column(1)
                got = predict(list(map(plain, texts)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()),
                                                  pa.array([g[1] for g in got], pa.float64())], names=["row", "lang_pred", "score"])

    src = docs.select(F.struct(*keep).alias("row"), *([] if kept else [F.col(text_col).alias("text")]))
    out = src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "lang_pred", "score")
