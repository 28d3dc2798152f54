"""Language identification: script ranges narrow the candidates of each word, Viterbi with a switching penalty labels spans.

A word's score in a language is the log-likelihood of its letter trigrams there. The model is fitted on
at most ``per_language`` labelled documents of each language, those with the least hashes of their doc_id (a documented
bound of the classifier's sample; rows that repeat under one doc_id and label are one); prediction reads every document whole.

Defined results: ``und`` with score 0 if the text is null, empty or has no letter, or if no language could be
learned; documents without a label are not learned from; texts of any length are labelled whole; repeated rows are
labelled each on its own; of tied languages the one first in alphabetical order is taken; other columns are not read;
an empty table gives an empty table, and a model without languages.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.llm.batches import sliced
from siltwork.llm.viterbi import decode
from siltwork.sources.session import shared_folder

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_spans long"
SPAN_SCHEMA = "doc_id long, start long, end long, lang string"

#: First code point of each block of letters, and its script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xA4D0, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 150_000
#: So many ids of the sample are broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of the words with a blank on either side, and where each word's begin: as many as it has letters."""
    p = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    middle = np.flatnonzero(p[1:-1] != 32)
    codes = (p[middle] << 42) | (p[middle + 1] << 21) | p[middle + 2]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return codes, np.cumsum(sizes) - sizes


@dataclass
class Model:
    """log-likelihoods: ``table[k]`` of trigram ``codes[k]`` by language, ``unknown`` of any other; ``uses[script]``: the candidates."""

    languages: list[str]
    codes: np.ndarray
    table: np.ndarray
    unknown: np.ndarray
    uses: np.ndarray
    penalty: float

    def scores(self, words: list[str]) -> np.ndarray:
        codes, starts = _trigrams(words)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        each = np.where((self.codes[at] == codes)[:, None], self.table[at], self.unknown)
        out = np.add.reduceat(each, starts, axis=0)
        first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
        allowed = self.uses[_SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]]
        least = out.min(1, keepdims=True) - 20
        out = np.where(allowed, out, least)
        out[~allowed.any(1)] = 0
        return (out - out.max(1, keepdims=True)).astype(np.float32)


def held_out(id_column) -> F.Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, per_language: int = 400, penalty: float = 12.0, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model:
    """Learns from the text and label of documents that are not held out; at most ``per_language`` documents a language (distinct doc_ids, those with the least hashes)."""
    shared_folder(docs.sparkSession)
    src = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"), docs[label_column].cast("string").alias("label"))
    ids = src.select("doc_id", "label").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("label").isNotNull()).distinct()
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language).select("doc_id", "label").checkpoint()
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    # One row of each doc_id and label, so no doc_id makes the sample large.
    sample = src.join(chosen, ["doc_id", "label"]).groupBy("label", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def counted(batches):
        for part, texts in sliced(batches, "text"):
            labels = part.column(1).to_pylist()
            for l in sorted(set(labels)):
                words = [w for t, own in zip(texts, labels, strict=True) if own == l for w in _WORD.findall((t or "").lower())]
                if words:
                    codes, n = np.unique(_trigrams(words)[0], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"label": [l] * len(codes), "code": codes, "n": n})

    rows = (
        sample.select("text", "label")
        .mapInArrow(counted, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(set(rows["label"]))
    if not languages:
        return Model([], np.zeros(1, np.int64), np.zeros((1, 0)), np.zeros(0), np.zeros((len(_NAMES), 0), bool), penalty)
    codes, where = np.unique(rows["code"].to_numpy(), return_inverse=True)
    n = np.zeros((len(codes), len(languages)))
    n[where, [languages.index(l) for l in rows["label"]]] = rows["n"].to_numpy()
    script = _SCRIPT[np.searchsorted(_STARTS, (codes >> 21) & 0x1FFFFF, side="right") - 1]
    share = np.stack([n[script == s].sum(0) for s in range(len(_NAMES))]) / n.sum(0)
    total = n.sum(0) + 0.3 * (len(codes) + 1)
    return Model(languages, codes, np.log((n + 0.3) / total), np.log(0.3 / total), share >= 0.01, penalty)


class _Labeller:
    def __init__(self, model: Model) -> None:
        self.model, self.index = model, {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def __call__(self, texts: list) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """(words by text, words of each, label of each word)."""
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        words = [w if any(map(str.isalpha, w)) else [] for w in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        if not flat or not self.model.languages:
            return words, sizes, np.zeros(len(flat), np.int8)
        if len(self.index) > _CACHE:
            self.index, self.table = {}, self.table[:0]
        new = list({w for w in flat if w not in self.index})
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.scores(new)])
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        return words, sizes, decode(self.table[at], sizes[sizes > 0], self.model.penalty)


def verdicts(texts: list, label: _Labeller) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, number of spans) of each text."""
    languages = label.model.languages
    k = len(languages)
    words, sizes, best = label(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letters = np.fromiter((len(w) for ws in words for w in ws), np.int64, len(owner))
    score, spans_, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if k and len(owner):
        share = np.bincount(owner * k + best, letters, minlength=len(texts) * k).reshape(-1, k)
        score = share.max(1) / np.maximum(share.sum(1), 1)
        lang = share.argmax(1)
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (best[1:] != best[:-1])
        spans_ = np.bincount(owner[new], minlength=len(texts))
    return [languages[lang[i]] if k and sizes[i] else "und" for i in range(len(texts))], np.where(sizes > 0, score, 0.0) if k else np.zeros(len(texts)), spans_


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document. score: the share of its letters in spans of ``lang_pred``. One pass, no shuffle."""

    def run(batches):
        label = _Labeller(model)
        for part, texts in sliced(batches, "text"):
            lang, score, n = verdicts(texts, label)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang), pa.array(score), pa.array(n.astype(np.int64))], names=["doc_id", "held_out", "lang_pred", "score", "n_spans"])

    ids = docs[id_column].cast("long")
    return docs.select(ids.alias("doc_id"), docs[text_column].alias("text"), F.coalesce(held_out(ids), F.lit(False)).alias("held_out")).mapInArrow(run, SCHEMA)


def identified(docs: DataFrame, model: Model, least: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows, all columns, of which one language has at least ``least`` of the letters; each is judged by its own text. One pass, no shuffle."""

    @F.arrow_udf("boolean")
    def speaks(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        label = _Labeller(model)
        for column in columns:
            yield pa.concat_arrays([_passes(texts, label) for _, texts in sliced([pa.RecordBatch.from_arrays([column], names=["text"])], "text")] or [pa.array([], pa.bool_())])

    def _passes(texts: list, label: _Labeller) -> pa.Array:
        lang, score, _ = verdicts(texts, label)
        return pa.array((np.array(lang) != "und") & (score >= least))

    # Only the texts go to Python, and a bit of each row comes back.
    return docs.where(speaks(docs[text_column]))


def spans(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The spans of one language in each document, in code points; from the first letter of a span to its last."""

    def run(batches):
        label = _Labeller(model)
        for part, texts in sliced(batches, "text"):
            _, sizes, best = label(texts)
            k = 0
            rows = []
            for doc, text, n in zip(part.column(0).to_pylist(), texts, sizes, strict=True):
                # lower() can change lengths, so words are found in the text as it stands; both have as many words.
                found = [m.span() for m in _WORD.finditer(text)] if n else []
                found = found if len(found) == n else [m.span() for m in _WORD.finditer(text.lower())] if n else []
                for (a, b), l in zip(found, best[k : k + n], strict=True):
                    if rows and rows[-1][0] == doc and rows[-1][4] == k and rows[-1][3] == l:
                        rows[-1][2] = b
                    else:
                        rows.append([doc, a, b, l, k])
                k += int(n)
            if rows and model.languages:
                yield pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "start": [r[1] for r in rows], "end": [r[2] for r in rows], "lang": [model.languages[r[3]] for r in rows]})

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, SPAN_SCHEMA)
