"""Toxicity by weak supervision: many voters, a generative model of their accuracies and correlations, a linear classifier on its posterior.

1. **Voters.** Lexicons by kind and language, patterns (address with an insult, masked letters, dismissal), terms that are mined, and densities of all lexicon words and mined
   terms together. Mined are whole words and word starts (3 to 6 letters) that labelled toxic documents hold far more often than clean ones: in long texts one occurrence is chance, so a document holds a term from one word in a thousand on. Mining looks at about SAMPLE labelled documents of each label, drawn by a hash of doc_id, at most;
   the best CANDIDATES terms by likelihood ratio are the candidates, and terms are taken one by one, each for the toxic documents that fewer than COVER of the
   terms taken before are in, so that a group of copies or a stem with many endings gives few terms.
2. **Votes.** One pass over all texts keeps which voters fire, with their levels (1 below RATES[0] of the text's words, 2, and 3 from RATES[1] on), as Parquet in the shared folder.
3. **Label model.** Documents are toxic or clean; in each a voter has a probability for each level. All documents, labelled or not, count: expectation
   maximisation runs over the distinct sets of votes with their numbers of documents, so copies and silent documents are one row. A round is one sum over
   them, of a number for each voter. The start is the voters' rates among the sampled labels. Then the voters' correlations within both classes are measured by
   the same sums for pairs, and a voter that speaks along with others counts less: its log-likelihood ratios are divided by one plus its correlations with them.
4. **Classifier.** Logistic regression of the posterior on what fires at which level, over the distinct feature sets of all documents.

Only labels of rows whose crc32(doc_id as text) mod 5 isn't 0 are used, for mining and the start; labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts, and those in which nothing fires, get the score of silence; documents without an id are scored and never labelled; a doc_id with
several labels has that of most of them (toxic, if equal), and all documents with the id have it; without labels the lexicons and patterns alone vote, from fixed rates; repeated rows get equal scores; an empty table
gives no rows; other columns aren't looked at. A label or toxic that is null isn't one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ._common import read_table, stored, text_key

#: Labelled documents of each label that mining looks at, about; candidates; terms taken; terms that a toxic document should hold.
SAMPLE = 20_000
CANDIDATES = 1000
TERMS = 128
COVER = 3
#: Share of a term's toxic documents that other terms must cover twice to make it dispensable, if clean ones hold it too.
ENOUGH = 0.95
#: A candidate's least likelihood ratio (G²), least labelled toxic documents and least share of toxic ones among those that hold it (classes as drawn).
LEAST_G2, LEAST_TOXIC, LEAST_SHARE = 25.0, 4, 0.8
ROUNDS = 12  # whatever the input, so that the work grows with it alone
#: Share of toxic documents, and how often a voter fires in toxic and clean ones, where no label says so.
SHARE, FIRES, FALSE = 0.05, 0.1, 0.002
#: Levels of a voter, and the shares of a text's words at which the second and the third begin.
LEVELS = 3
#: Labelled clean documents that hold a lexicon's word, from which on it must be twice as frequent in toxic ones; else it isn't abuse in these texts and is left out.
REFUTED = 5
RATES = (0.001, 0.005)
#: Voters of density: least hits of lexicon words and mined terms together, and their least share of the words.
DENSITIES = ((2, 0.004), (2, 0.008), (3, 0.012), (4, 0.02))

# Words of abuse by language and kind.
LEXICONS = {
    "en insult": "idiot idiots moron morons stupid dumb imbecile fool fools clown loser losers dimwit halfwit",
    "en contempt": "pathetic worthless disgusting trash garbage scum vermin filth useless repulsive",
    "en profanity": "fuck fucking shit bullshit bitch bastard asshole damn crap",
    "en threat": "kill murder hurt destroy",
    "de insult": "idiot idioten dumm dummkopf trottel depp versager vollidiot blödmann",
    "de contempt": "abschaum wertlos widerlich erbärmlich dreck müll",
    "fr insult": "idiot idiote imbécile stupide crétin débile abruti",
    "fr contempt": "pathétique minable dégoûtant ordure déchet pourriture",
    "es insult": "idiota imbécil estúpido estúpida tonto payaso perdedor",
    "es contempt": "patético patética basura asqueroso asquerosa escoria inútil",
}
# Patterns of abuse, over the lower-case text but for shouting.
PATTERNS = {
    "address": r"\b(?:you|ihr|du|tu|vous|eres)\s+(?:are\s+|bist\s+|seid\s+|es\s+|êtes\s+)?(?:an?\s+|such\s+an?\s+|ein\s+|une?\s+|un\s+)?(?:idiot|moron|clown|loser|fool|trottel|versager|imbécile|idiota)",
    "masked": r"\b[fsb][*#@!$]{2,}[a-z]*\b",
    "go away": r"\b(?:shut up|get lost|go to hell|halt die klappe|ta gueule|cállate)\b",
}
NAMES = [*LEXICONS, *PATTERNS, *[f"density {share}" for _, share in DENSITIES]]
_WORD = re.compile(r"[^\W\d_]+")
_FIND = [re.compile(p) for p in PATTERNS.values()]
_LEXICON: dict[str, list[int]] = {}
for _i, _words in enumerate(LEXICONS.values()):
    for _w in _words.split():
        _LEXICON.setdefault(_w, []).append(_i)
KNOWN_WORDS = 300_000
FLUSH = 400_000


def training(doc_id):
    """Whether a row's label may be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0, F.lit(False))


def starts(word: str) -> list[str]:
    """The terms a word may stand for: its starts of 3 to 6 letters (with *), if it goes on, and itself."""
    return [f"{word[:k]}*" for k in range(3, 7) if len(word) > k] + [word]


def held_terms(text: str) -> list[str]:
    """Terms that are at least RATES[0] of the text's words."""
    words = Counter(_WORD.findall(text.lower()))
    n = sum(words.values())
    times: Counter = Counter()
    for w, k in words.items():
        for t in starts(w[:64]):
            times[t] += k
    return [t for t, k in times.items() if k >= RATES[0] * n]


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_key, text and toxic (0 or 1) of the labelled documents that mining looks at: about ``sample`` ids of each label, by a hash."""
    rows = labels.filter(training(F.col("doc_id")) & F.col("toxic").isNotNull())
    voted = rows.groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("toxic"))
    totals = {r[0]: r[1] for r in voted.groupBy("toxic").count().collect()}
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / max(1, totals.get(1, 0))))).otherwise(F.lit(min(1.0, sample / max(1, totals.get(0, 0)))))
    chosen = voted.filter(lot <= share)
    # At most about 2 * sample ids.
    return docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select(text_key().alias("doc_key"), "text", "toxic")


def _candidates(rows: DataFrame, toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """The CANDIDATES terms with the highest ratios, of equal ones the longer; and the lexicons' words that clean documents hold as often as toxic ones, or nearly so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> pa.RecordBatch:
            terms = list(counts[1].keys() | counts[0].keys())
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0)]], ["term", "a", "b"])
            counts[0].clear(), counts[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[label].update(held_terms(text.as_py()))
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield flush()
        yield flush()

    sums = rows.select("text", "toxic").mapInArrow(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(toxic + clean)
    cell = lambda x, row, column: F.when(x > 0, 2 * x * F.log(x * n / (row * column))).otherwise(0.0)
    g2 = cell(a, F.lit(float(toxic)), a + b) + cell(b, F.lit(float(clean)), a + b) + cell(toxic - a, F.lit(float(toxic)), n - a - b) + cell(clean - b, F.lit(float(clean)), n - a - b)
    own = F.col("term").isin(list(_LEXICON))
    good = (a >= LEAST_TOXIC) & (a / toxic >= LEAST_SHARE * (a / toxic + b / clean)) & (g2 >= LEAST_G2)
    some = sums.filter(good | own).select("term", "a", "b", good.alias("good"), own.alias("own")).orderBy(own.desc(), g2.desc(), F.length("term").desc(), "term")
    found = some.limit(CANDIDATES + len(_LEXICON)).collect()
    refuted = [r["term"] for r in found if r["own"] and r["b"] >= REFUTED and r["a"] / toxic < 2 * r["b"] / clean]
    return [r["term"] for r in found if r["good"]][:CANDIDATES], refuted


def chosen(held: list[set[int]], toxic: list[int], n_terms: int, totals: tuple[int, int], most: int = TERMS, cover: int = COVER, least: int = LEAST_TOXIC) -> list[int]:
    """Terms one by one, each that with the most toxic documents not yet holding ``cover`` of those taken, less half its clean ones; ties go to the earlier candidate.

    Then, the least pure first, terms go that are dispensable: ENOUGH of their toxic documents hold two others that stay; and others are taken for what they leave. totals: all toxic and clean documents, also those that hold no
    candidate. A term's purity is the share of toxic ones among those that hold it, if both classes were equally large.
    """
    rows = [np.array(sorted(d), np.int64) for d in ([{i for i, h in enumerate(held) if t in h} for t in range(n_terms)])]
    label, open_, taken, gone = np.array(toxic, np.int64), np.full(len(held), cover), [], []

    def take() -> None:
        while len(taken) < most:
            gains = [-1 if t in taken or t in gone else float((label[r] * (open_[r] > 0)).sum() - (1 - label[r]).sum() / 2) for t, r in enumerate(rows)]
            best = int(np.argmax(gains)) if gains else -1
            if best < 0 or gains[best] < least:
                break
            taken.append(best)
            open_[rows[best]] -= 1

    take()
    share = {t: (label[rows[t]].sum() / max(1, totals[0]), (1 - label[rows[t]]).sum() / max(1, totals[1])) for t in taken}
    for t in sorted(taken, key=lambda t: (share[t][0] / sum(share[t]), -taken.index(t))):
        others = cover - open_[rows[t]][label[rows[t]] == 1] - 1
        if share[t][1] > 0 and (others >= 2).mean() >= ENOUGH:
            taken.remove(t)
            gone.append(t)
            open_[rows[t]] += 1
    take()
    return taken


def mined(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Words and word starts (ending in *) that mark labelled toxic documents, at most TERMS; and the lexicons' words that labels refute."""
    rows = stored(sampled(docs, labels, sample).repartition(F.col("doc_key")), "toxic-sample")
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").agg(F.count_distinct("doc_key")).collect()}
    if not totals.get(1) or not totals.get(0):
        return [], []
    candidates, refuted = _candidates(rows.dropDuplicates(["doc_key", "toxic"]), totals[1], totals[0])
    number = {t: i for i, t in enumerate(candidates)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(number[t] for t in held_terms(text.as_py()) if t in number) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["held", "toxic", "doc_key"])

    held = rows.select("text", "toxic", "doc_key").mapInArrow(run, "held array<int>, toxic int, doc_key string").filter(F.size("held") > 0).dropDuplicates(["doc_key", "toxic"])
    # Bounded by SAMPLE documents of each label, and their candidates.
    own = held.select("held", "toxic").collect()
    own.sort(key=lambda r: (r["held"], r["toxic"]))
    terms = [candidates[i] for i in chosen([set(r["held"]) for r in own], [r["toxic"] for r in own], len(candidates), (totals[1], totals[0]))]
    return terms, refuted


def votes(docs: DataFrame, terms: list[str], refuted: list[str]) -> DataFrame:
    """docs without text, and fired: the voters that fire, ascending, with their levels, as voter * 4 + level."""
    shared = docs.sparkSession.sparkContext.broadcast(({t: len(NAMES) + i for i, t in enumerate(terms)}, {w: v for w, v in _LEXICON.items() if w not in refuted}))
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")).schema.add("fired", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, lexicon = shared.value
        known: dict[str, tuple] = {}
        for batch in batches:
            fired = []
            for text in batch.column(1):
                low = (text.as_py() or "").lower()
                if len(known) > KNOWN_WORDS:
                    known = {}
                speak, hits, n_words = Counter(), 0, 0
                for w in low.split():
                    parts = known.get(w)
                    if parts is None:
                        found = _WORD.findall(w)
                        each = [tuple(v for v in [*lexicon.get(x, ()), *(number[t] for t in starts(x[:64]) if t in number)]) for x in found]
                        parts = known[w] = (len(found), [x for x in each if x])
                    n_words += parts[0]
                    for voters in parts[1]:
                        hits += 1
                        speak.update(voters)
                for i, pattern in enumerate(_FIND):
                    n = sum(1 for _ in pattern.finditer(low))
                    if n:
                        speak[len(LEXICONS) + i] += n
                levels = {v: 1 + sum(n >= r * n_words for r in RATES) for v, n in speak.items()}
                levels |= {len(LEXICONS) + len(PATTERNS) + i: LEVELS for i, (least, share) in enumerate(DENSITIES) if hits >= max(least, share * n_words)}
                fired.append([v * 4 + k for v, k in sorted(levels.items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fired, pa.list_(pa.int32()))], ["row", "fired"])

    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text").mapInArrow(run, schema)
    return found.select(*[F.col("row")[c].alias(c) for c in others], "fired")


def log_odds(prior: float, on: np.ndarray, off: np.ndarray, scale: np.ndarray) -> tuple[float, list[float]]:
    """Of silence, and what each code (voter * 4 + level) adds; on and off (voters by levels 1 to 3): how likely the levels are in toxic and in clean documents."""
    silent = (np.log1p(-on.sum(axis=1)) - np.log1p(-off.sum(axis=1))) / scale
    adds = np.zeros((len(scale), LEVELS + 1))
    adds[:, 1:] = (np.log(on) - np.log(off)) / scale[:, None] - silent[:, None]
    return math.log(prior / (1 - prior)) + float(silent.sum()), adds.ravel().tolist()


def _posterior(base: float, adds: list[float]):
    """Of a column ``fired``."""
    table = F.array(*[F.lit(float(x)) for x in adds])
    z = F.aggregate("fired", F.lit(float(base)), lambda s, v: s + F.get(table, v))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _rates(hits: np.ndarray, size: float, fixed: float) -> np.ndarray:
    """Rates of levels, drawn to a fixed one by as much as ten documents, so that none is 0 or 1."""
    return np.maximum((hits + 10 * fixed / LEVELS) / (size + 10), 1e-7)


def _speaking(on: np.ndarray, off: np.ndarray) -> np.ndarray:
    """on, where votes (levels 2 and 3) speak for toxicity, or for nothing; a voter's levels sum up to less than 1."""
    on = np.concatenate([on[:, :1], np.maximum(on[:, 1:], off[:, 1:])], axis=1)
    return on * np.minimum(1, (1 - 1e-6) / on.sum(axis=1, keepdims=True))


def label_model(sets: DataFrame, n_voters: int, on: np.ndarray, off: np.ndarray, prior: float, rounds: int = ROUNDS) -> tuple[float, list[float], dict]:
    """Log-odds of silence and of each code, from the sets (fired, n) of all documents; and the estimates by name.

    A round's sums for each code and, once, those of pairs of voters are all that the driver gets.
    """
    n_all = sets.agg(F.sum("n")).first()[0] or 0
    scale = np.ones(n_voters)
    for _ in range(rounds if n_all else 0):
        p = sets.withColumn("p", _posterior(*log_odds(prior, on, off, scale)))
        # -1 stands for the document itself.
        sums = p.select(F.explode(F.concat(F.array(F.lit(-1)), "fired")).alias("code"), "p", "n").groupBy("code").agg(F.sum(F.col("p") * F.col("n")).alias("a"), F.sum("n").alias("n")).collect()
        a, n, toxic = np.zeros((n_voters, LEVELS + 1)), np.zeros((n_voters, LEVELS + 1)), 0.0
        for r in sums:
            if r["code"] < 0:
                toxic = r["a"]
            else:
                a[divmod(r["code"], 4)], n[divmod(r["code"], 4)] = r["a"], r["n"]
        prior = float(np.clip((toxic + 10 * SHARE) / (n_all + 10), 1e-6, 0.5))
        on, off = _rates(a[:, 1:], toxic, FIRES), _rates((n - a)[:, 1:], n_all - toxic, FALSE)
        on = _speaking(on, off)
    correlation = np.zeros((n_voters, n_voters))
    if n_all:
        p = sets.withColumn("p", _posterior(*log_odds(prior, on, off, scale))).withColumn("voters", F.transform("fired", lambda x: F.shiftright(x, 2)))
        pairs = p.select(F.explode("voters").alias("v"), "voters", "p", "n").select("v", F.explode("voters").alias("u"), "p", "n").filter("v < u")
        toxic = p.agg(F.sum(F.col("p") * F.col("n"))).first()[0]
        any_on, any_off = on.sum(axis=1), off.sum(axis=1)
        for r in pairs.groupBy("v", "u").agg(F.sum(F.col("p") * F.col("n")).alias("a"), F.sum((1 - F.col("p")) * F.col("n")).alias("b")).collect():
            v, u = r["v"], r["u"]
            for both, size, rate in ((r["a"], toxic, any_on), (r["b"], n_all - toxic, any_off)):
                spread = math.sqrt(rate[v] * (1 - rate[v]) * rate[u] * (1 - rate[u]))
                if size > 1 and spread > 0:
                    correlation[v, u] += 0.5 * float(np.clip((both / size - rate[v] * rate[u]) / spread, 0, 1))
        correlation += correlation.T
        scale = 1 + correlation.sum(axis=1)
    base, adds = log_odds(prior, on, off, scale)
    return base, adds, {"prior": prior, "on": on, "off": off, "correlation": correlation}


def first_rates(fired: DataFrame, labels: DataFrame, n_voters: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The voters' rates among labelled documents (fired: doc_id, fired) that may be learned from, and the share of toxic ones; from fixed values without any."""
    rows = labels.filter(training(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("toxic"))
    # Of a doc_id with many rows each distinct set of votes counts once.
    own = fired.filter("doc_id IS NOT NULL").select("doc_id", "fired").distinct().join(rows, "doc_id")
    n = np.zeros((2, n_voters, LEVELS + 1))
    sizes = [0, 0]
    for r in own.select("toxic", F.explode(F.concat(F.array(F.lit(-1)), "fired")).alias("code")).groupBy("toxic", "code").count().collect():
        if r["code"] < 0:
            sizes[r["toxic"]] = r["count"]
        else:
            n[(r["toxic"], *divmod(r["code"], 4))] = r["count"]
    on, off = _rates(n[1, :, 1:], sizes[1], FIRES), _rates(n[0, :, 1:], sizes[0], FALSE)
    return _speaking(on, off), off, min(0.5, (sizes[1] + 10 * SHARE) / (sum(sizes) + 10))


def _place(fired):
    """The classifier's feature of a voter with its level."""
    return (F.shiftright(fired, 2) * LEVELS + fired.bitwiseAND(F.lit(3)) - 1).cast("int")


def classifier(sets: DataFrame, n_voters: int, base: float, adds: list[float]) -> tuple[float, list[float]]:
    """Intercept and weights (voter * LEVELS + level - 1) of the logistic regression of the posterior; sets: fired, n. Where all documents are silent, the label model's own."""
    width = n_voters * LEVELS
    rows = sets.withColumn("p", _posterior(base, adds))
    if sets.limit(2).count() < 2:
        return base, [adds[i // LEVELS * 4 + i % LEVELS + 1] for i in range(width)]
    features = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains("places", i).cast("double"))
    rows = rows.withColumn("places", F.transform("fired", _place))
    sides = [F.struct(F.lit(float(label)).alias("label"), (p * F.col("n")).alias("weight")) for label, p in ((1, F.col("p")), (0, 1 - F.col("p")))]
    both = rows.select(array_to_vector(features).alias("features"), F.explode(F.array(*sides)).alias("x"))
    model = LogisticRegression(maxIter=40, regParam=1e-5, standardization=False, weightCol="weight").fit(both.select("features", "x.label", "x.weight"))
    return float(model.intercept), model.coefficients.toArray().tolist()


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without text, and score (0 to 1); docs: doc_id, text and any others, labels: doc_id, toxic."""
    terms, refuted = mined(docs, labels, sample)
    n_voters = len(NAMES) + len(terms)
    fired = stored(votes(docs, terms, refuted), "toxic-votes")
    on, off, prior = first_rates(fired, labels, n_voters)
    distinct = stored(fired.groupBy("fired").agg(F.count(F.lit(1)).alias("n")), "toxic-sets")
    base, adds, _ = label_model(distinct, n_voters, on, off, prior)
    intercept, weights = classifier(distinct, n_voters, base, adds)
    table = F.array(*[F.lit(float(w)) for w in weights])
    z = F.aggregate("fired", F.lit(intercept), lambda s, x: s + F.get(table, _place(x)))
    return fired.withColumn("score", 1 / (1 + F.exp(-z))).drop("fired")


def op13_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = ~training(F.col("doc_id")) & F.col("doc_id").isNotNull()
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
