"""Language identification of mixed texts: script ranges, per-word scores and a Viterbi path with a switching penalty.

The model is naive Bayes over the character n-grams (1 to 3, with word ends) of labelled documents: about PER_LANGUAGE different texts of each
language, all if there are fewer, drawn by a hash of the text; equal texts count once. A word's script narrows its candidates to the languages that
write in it; each word is scored once in a worker. The best path through a text's words pays SWITCH for every change of
language; its runs are the spans. A text's language is that of most of its letters, and the score their share.

Most texts have one language. If no stretch of words gains more than SWITCH by leaving the best single
language, the constant path is the best one, and is taken without the search.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled document every text is. Words in a
script that no learned language has are scored alike for all languages; ties go to the language that sorts first. A null doc_id isn't held out. Repeated
rows get equal results; an empty table gives no rows; lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import read_table

PER_LANGUAGE = 1000
SWITCH = 20.0
UNKNOWN = "und"
#: Words whose scores a worker keeps.
KNOWN_WORDS = 250_000
#: Longer chunks aren't kept.
LONGEST = 64

#: First code point and script of Unicode's letter ranges; 0 is any other script.
SCRIPT_RANGES = [
    (0x0000, 1), (0x0250, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7),
    (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0), (0x0B80, 11), (0x0C00, 12), (0x0C80, 13), (0x0D00, 14), (0x0D80, 0),
    (0x0E00, 15), (0x0E80, 16), (0x0F00, 17), (0x1000, 18), (0x10A0, 19), (0x1100, 20), (0x1200, 21), (0x13A0, 0), (0x1E00, 1),
    (0x1F00, 2), (0x2000, 0), (0x3040, 22), (0x3100, 0), (0x3130, 20), (0x3190, 0), (0x3400, 23), (0xA000, 0), (0xAC00, 20), (0xD800, 0),
    (0xF900, 23), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 1), (0xFF66, 22), (0x20000, 23),
]
_STARTS = [a for a, _ in SCRIPT_RANGES]
_WORD = re.compile(r"[^\W\d_]+")


def script(letter: str) -> int:
    return SCRIPT_RANGES[bisect_right(_STARTS, ord(letter)) - 1][1]


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [*word, *[w[i : i + 2] for i in range(len(w) - 1)], *[w[i : i + 3] for i in range(len(w) - 2)]]


def words(text: str | None) -> list[str]:
    return [w for w in _WORD.findall((text or "").lower()) if w[0].isalpha() or any(map(str.isalpha, w))]


class Model:
    """Scores of words: for each language the logarithm of how likely the word's n-grams are, by n-gram order on average."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray], scripts: dict[int, list[bool]]):
        self.languages, self.scripts = languages, scripts
        n = len(languages)
        totals = np.zeros((4, n))
        kinds = np.zeros(4)
        for g, c in grams.items():
            totals[len(g)] += c
            kinds[len(g)] += 1
        rows = [np.log(c + 0.5) - np.log(totals[len(g)] + 0.5 * (kinds[len(g)] + 1)) for g, c in grams.items()]
        unseen = [np.log(0.5) - np.log(totals[k] + 0.5 * (kinds[k] + 1)) for k in (1, 2, 3)]
        self.table = (np.array([*rows, *unseen]).reshape(len(rows) + 3, n) / 3).astype(np.float32)
        self.row = {g: i for i, g in enumerate(grams)}
        self.unseen = {k: len(grams) + k - 1 for k in (1, 2, 3)}
        self.known: dict[str, int] = {}
        self.chunks: dict[str, bytes] = {}
        self.scores = np.zeros((0, n), np.float32)
        self.letters, self.readable = np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        """Put words into the tables."""
        flat, starts = [], []
        for w in new:
            starts.append(len(flat))
            flat += [self.row.get(g, self.unseen[len(g)]) for g in _grams(w)]
        scores = np.add.reduceat(self.table[np.array(flat)], np.array(starts), axis=0)
        base, more = len(self.known), len(new)
        readable = np.ones(more, bool)
        for i, w in enumerate(new):
            mask = self.scripts.get(script(w[0]))
            if mask is None or not any(mask):
                scores[i], readable[i] = 0, False
            elif not all(mask):
                scores[i, ~np.array(mask)] = scores[i].min() - 1e4
        if len(self.scores) < base + more:
            room = base + 2 * more
            self.scores = np.concatenate([self.scores[:base], np.zeros((room, len(self.languages)), np.float32)])
            self.letters = np.concatenate([self.letters[:base], np.zeros(room, np.int64)])
            self.readable = np.concatenate([self.readable[:base], np.zeros(room, bool)])
        self.scores[base : base + more], self.readable[base : base + more] = scores, readable
        self.letters[base : base + more] = list(map(len, new))
        self.known.update((w, base + i) for i, w in enumerate(new))

    def indices(self, texts: list[str | None]) -> list[np.ndarray]:
        """Rows of ``scores``, ``letters`` and ``readable`` for each text's words; the tables of known words and chunks are bounded.

        White space ends words, so a text's words are those of its chunks between white space, and each distinct chunk is looked at once.
        """
        if len(self.known) > KNOWN_WORDS or len(self.chunks) > 2 * KNOWN_WORDS:
            self.known, self.chunks = {}, {}
        split = [(t or "").split() for t in texts]
        new = {c: words(c) for c in set().union(*split).difference(self.chunks)}
        unknown = {w for ws in new.values() for w in ws}.difference(self.known)
        if unknown:
            self._learn(list(unknown))
        long = {}
        for c, ws in new.items():
            (self.chunks if len(c) <= LONGEST else long)[c] = np.fromiter(map(self.known.__getitem__, ws), np.int32, len(ws)).tobytes()
        known = self.chunks.__getitem__ if not long else lambda c: self.chunks[c] if c in self.chunks else long[c]
        return [np.frombuffer(b"".join(map(known, t)), np.int32) for t in split]

    def paths(self, rows: list[np.ndarray], penalty: float = SWITCH) -> list[np.ndarray]:
        """For each text (rows of ``scores`` for its words, at least one) the language of each word on the best path."""
        out: list[np.ndarray] = []
        search = []
        for r in rows:
            s = self.scores[r]
            best = int(s.sum(axis=0, dtype=np.float64).argmax())
            gain = np.concatenate([[0], np.cumsum((s - s[:, best : best + 1]).max(axis=1), dtype=np.float64)])
            if (gain - np.minimum.accumulate(gain)).max() > penalty:
                search.append(len(out))
            out.append(np.full(len(s), best, np.int64))
        for i, path in zip(search, viterbi([self.scores[rows[i]] for i in search], penalty), strict=True):
            out[i] = path
        return out


def viterbi(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best path through each text's scores (words by languages). A step takes the next word of all texts that have one."""
    if not texts:
        return []
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    s = np.concatenate([texts[i] for i in order])
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts with a word at each step
    kind = np.min_scalar_type(s.shape[1])
    own = np.arange(s.shape[1], dtype=kind)
    back = np.empty(s.shape, kind)
    value = s[starts].astype(np.float64)
    for t in range(1, lengths[0]):
        n = active[t]
        v, at = value[:n], starts[:n] + t
        top = v.argmax(axis=1)
        floor = v[np.arange(n), top] - penalty
        switch = v < floor[:, None]
        back[at] = np.where(switch, top[:, None].astype(kind), own)
        np.maximum(v, floor[:, None], out=v)
        v += s[at]
    labels = np.empty(len(s), np.int64)
    now = value.argmax(axis=1)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    out: list[np.ndarray] = [labels[:0]] * len(texts)
    for i, a, n in zip(order, starts, lengths, strict=True):
        out[i] = labels[a : a + n]
    return out


def _held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple:
    """Languages, n-gram counts and scripts from labelled documents that aren't held out.

    A language has per_language different texts of them, or all if there are fewer: those whose lot, a hash of the text, is below per_language over their
    number. So their number varies about per_language by its square root, and copies neither crowd others out nor share a lot with them. The driver gets
    the sums by n-gram: at most those of per_language texts for each language.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out(F.col("doc_id"))).select("lang", "doc_id", "text")
    # A text's lot decides, by itself: no language's documents meet in a task. Hashes are counted, and only texts of the sample are shuffled.
    counts = labelled.select("lang", F.xxhash64("text").alias("_h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    lot = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = labelled.join(F.broadcast(counts), "lang").filter(lot < F.lit(float(per_language)) / F.col("_n"))
    sample = drawn.groupBy("lang", F.md5(F.col("text").cast("binary")).alias("_k")).agg(F.first("text").alias("text")).select("_k", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        scripts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, letters = counts.setdefault(lang, Counter()), scripts.setdefault(lang, Counter())
                for w, n in Counter(words(text)).items():
                    letters[script(w[0])] += n * len(w)
                    for g in _grams(w):
                        own[g] += n
        rows = [(lang, f"g{g}", n) for lang, c in counts.items() for g, n in c.items()] + [(lang, f"s{k}", n) for lang, c in scripts.items() for k, n in c.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "key", "n"])

    sums = sample.mapInArrow(run, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rows = sums.collect()
    languages = sorted({r["lang"] for r in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    grams: dict[str, np.ndarray] = {}
    letters: dict[int, np.ndarray] = {}
    for r in rows:
        kind, key = r["key"][0], r["key"][1:]
        into, key = (grams, key) if kind == "g" else (letters, int(key))
        into.setdefault(key, np.zeros(len(languages)))[place[r["lang"]]] += r["n"]
    grams = {g: c for g, c in sorted(grams.items()) if c.sum() > 1}
    all_letters = sum(letters.values()) if letters else np.zeros(0)
    return languages, grams, {k: (c > 0.01 * all_letters).tolist() for k, c in letters.items()}


_models: dict[str, Model] = {}


def _model(shared) -> Model:
    """One for each worker process and trained model, so that its scores of words serve all of the worker's tasks."""
    key, parts = shared.value
    if key not in _models:
        _models.clear()
        _models[key] = Model(*parts)
    return _models[key]


def spans(text: str | None, model: Model, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """Start, end and language of each run of words with one language, as places in the text's lower-case form."""
    out: list[tuple[int, int, str]] = []
    at = [m for m in _WORD.finditer((text or "").lower()) if any(map(str.isalpha, m[0]))]
    for m, label in zip(at, labels.tolist(), strict=True):
        lang = model.languages[label]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], m.end(), lang)
        else:
            out.append((m.start(), m.end(), lang))
    return out


def identified(docs: DataFrame, trained: tuple, with_spans: bool = False) -> DataFrame:
    """docs (text, ...) with lang_pred, score, readable (the share of letters in scripts of learned languages), and spans (start, end, lang) if asked for; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, trained))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                texts = some.column(1).to_pylist()
                pred, score, readable, runs = [], [], [], []
                rows = model.indices(texts) if model.languages else [np.zeros(0, np.int32) for _ in texts]
                found = iter(model.paths([r for r in rows if len(r)]))
                for text, r in zip(texts, rows, strict=True):
                    if not len(r):
                        pred.append(UNKNOWN), score.append(0.0), readable.append(0.0), runs.append([])
                        continue
                    labels, sizes = next(found), model.letters[r]
                    letters = np.bincount(labels, weights=sizes, minlength=len(model.languages))
                    pred.append(model.languages[int(letters.argmax())]), score.append(float(letters.max() / letters.sum()))
                    readable.append(float(sizes[model.readable[r]].sum() / sizes.sum()))
                    runs.append([dict(zip(("start", "end", "lang"), x, strict=True)) for x in spans(text, model, labels)] if with_spans else [])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(readable, pa.float64()), pa.array(runs, span)], ["row", "lang_pred", "score", "readable", "spans"])

    new = ["lang_pred", "score", "readable"] + ["spans"] * with_spans
    others = [c for c in docs.columns if c not in new]
    # The row is kept in one column, so that its own columns may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")
    added = StructType.fromDDL("lang_pred string, score double, readable double, spans array<struct<start: long, end: long, lang: string>>")
    schema = StructType([rows.schema["row"], *added.fields])
    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col("row")[c].alias(c) for c in others], *new)


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identified(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "readable")
