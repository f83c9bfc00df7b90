"""Abusive, hateful and sexual content: a classifier chain over the segments of a text.

A text is cut into segments (sentences and lines, longer ones in overlapping windows); its words are undisguised (case, accents, look-alike
letters, digits for letters, spaced or stretched spelling, invisible characters) and names, hosts, numbers
and the like are masked. Linear models over the words and word pairs of a segment predict one category after
the other - insult, threat, demeaning, sexual, and at last toxic - and each gets the earlier categories'
probabilities as inputs. While the chain is trained these inputs are *out-of-fold* predictions, so later
models learn how far earlier ones can be trusted on texts they have not seen. A document's score is that of
its worst segment.

The reviewed sample labels whole documents, with errors. Only features that toxic documents hold significantly
more often are used, beside the seed words, so that mislabelled documents cannot teach common sentences. A
segment's target is the share of toxic verdicts among its documents; in rounds, verdicts that another segment
explains are left out. Which category a toxic segment belongs to is bootstrapped: seed words begin it, what surrounds them
decides. Features, targets and categories of a fold are found without that fold's documents.

Training is done on the driver on at most ``max_labelled`` reviewed documents (those with the least hash of
their id) and at most ``max_features`` features; scoring is a narrow pass over all documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.session import ship_package

MAX_LABELLED = 8000
MAX_FEATURES = 150_000
FOLDS = 3
ROUNDS = 3
MIN_LEAN, MIN_Z, MIN_DOCS = 0.5, 4.0, 5
CATEGORIES = ["insult", "threat", "demeaning", "sexual", "toxic"]

# fixed values: seed words by category (English, German, Spanish, French); those with a question mark also have
# harmless uses, so they tell a toxic segment's category but not that it is toxic
SEEDS = {
    "insult": (
        "idiot moron imbecile cretin asshole shithead scumbag wanker prick bitch bastard dumbass dickhead loser? parasite? worthless? "
        "vollidiot drecksack arschloch wichser schlampe hurensohn missgeburt trottel nutzloser? "
        "gilipollas cabron estupido imbecil mierda puta pendejo inutil? "
        "connard salaud salope abruti encule enfoire merde debile? ordure?"
    ),
    "threat": (
        "kill? hurt? burn? bullet? rope? stab? strangle legs? alive? "
        "umbringen toten? brechen? knochen? abstechen erschiessen "
        "matar? matare romper? piernas? quemar? "
        "tuer? casser? jambes? bruler? crever?"
    ),
    "demeaning": (
        "vermin? subhuman cripples? animals? thieves? stink? breed? rats? filth? gas? boat? "
        "ungeziefer? untermenschen abschaum vergasen "
        "alimanas? escoria ladrones? ratas? "
        "vermine? racaille sous-hommes voleurs?"
    ),
    "sexual": (
        "pussy tits slut porn? fuck horny panties licking? nudes cock? whore naked? "
        "nacktbilder ficke titten fotze geil "
        "tetas follar desnuda? polla "
        "nichons baiser? seins nue?"
    ),
}
SEED_WEIGHT = 2.0
BIAS = -3.2

_INVISIBLE = dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD, *range(0x202A, 0x202F), *range(0x2066, 0x206A)])
# fixed values: letters of other scripts that look like Latin ones
_ALIKE = str.maketrans(
    "авеіјкмнорсѕтухԁɡһӏοαερτυνικχßøłđæœ",
    "abeijkmhopcstyxdghloaeptuvikxsoldao",
)
_DIGITS = str.maketrans("0134578@$!|+€", "oieastbasiite")
_SPACED = re.compile(r"(?<![\w.])[^\W\d_](?:[ .\-_*·][^\W_]){2,}(?![\w.]?\w)")
_QUERY = re.compile(r"[?&]\w{1,12}=(\S+)")
WINDOW, STRIDE = 14, 7
_JOINTS = re.compile(r"[ .\-_*·]")
_SEGMENTS = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|[\r\n  ]+|[\"“”»«]")
_EDGES = " \t,;:!?.\"'()[]{}<>«»“”‘’…*#`~=|¡¿"
_LETTERS = re.compile(r"[^\W\d_]")
_REPEATS = re.compile(r"(.)\1+")
_CACHE = 400_000


def _fold(word: str) -> str:
    """A word as what it sounds like: plain lower-case Latin letters, look-alikes of i and l as one, no repeats."""
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word).casefold().translate(_ALIKE)
        word = "".join(c for c in word if not unicodedata.combining(c))
    word = word.casefold().translate(_DIGITS).replace("l", "i")
    return _REPEATS.sub(r"\1", word)


def _token(raw: str) -> str:
    """The normal form of one blank-separated token; '' if it is to be left out."""
    core = raw.strip(_EDGES)
    if not core:
        return "" if "!" not in raw else "!"
    if not _LETTERS.search(core):
        return "<n>"
    at = core.find("@", 1)
    if "." in core[1:-1] or core[0] == "@" or (at > 0 and "." in core[at:]) or "/" in core or "\\" in core or ":" in core or "=" in core:
        return "<n>"
    digits = sum(c.isdigit() for c in core)
    if digits and ("-" in core or digits > 4 or len(core) - digits < 2 or len(core) > 24):
        return "<n>"
    return _fold(core)


class Segmenter:
    """Texts to segments of normal tokens; remembers tokens."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def segments(self, text: str) -> list[list[str]]:
        if not text.isascii():
            text = text.translate(_INVISIBLE)
        if "=" in text and _QUERY.search(text):  # words in the query of an address
            text = _QUERY.sub(lambda m: "\n" + unquote_plus(m[1], errors="replace") + "\n", text)
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: _JOINTS.sub("", m[0]), text)
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        out = []
        for piece in _SEGMENTS.split(text):
            if not piece:
                continue
            tokens = []
            for raw in piece.split():
                token = known.get(raw)
                if token is None:
                    token = known[raw] = _token(raw)
                if token:
                    tokens.append(token)
            if len(tokens) <= WINDOW + STRIDE // 2:
                if tokens:
                    out.append(tokens)
            else:
                out += [tokens[i : i + WINDOW] for i in range(0, len(tokens) - WINDOW + STRIDE, STRIDE)]
        return out


def features(tokens: list[str]) -> list[str]:
    """Words, word pairs and pairs with one word between."""
    out = list(tokens)
    out += [f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)]
    out += [f"{a} _ {b}" for a, b in zip(tokens, tokens[2:], strict=False)]
    return out


def _seeds() -> dict[str, set[str]]:
    return {c: {_fold(w.rstrip("?")) for w in words.split()} for c, words in SEEDS.items()}


def _certain() -> set[str]:
    return {_fold(w) for words in SEEDS.values() for w in words.split() if not w.endswith("?")}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """A sparse matrix of ones in rows, as column numbers and row starts."""

    def __init__(self, lists: list[list[int]], width: int) -> None:
        self.width = width
        self.lengths = np.array([len(x) for x in lists], np.int64)
        self.columns = np.fromiter((c for x in lists for c in x), np.int64, int(self.lengths.sum()))
        self.of = np.repeat(np.arange(len(lists)), self.lengths)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.columns], len(self.lengths))

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, v[self.of], self.width)


def fit_linear(x: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, l2: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression, weights drawn towards ``prior``: weights, weights of ``extra`` columns, bias.

    Limited-memory quasi-Newton steps, scaled by the curvature's diagonal, with backtracking.
    """
    n, k = x.width, extra.shape[1]
    centre = np.concatenate([prior, np.zeros(k), [BIAS]])
    pull = np.concatenate([np.full(n, l2), np.full(k, 0.1), [1e-3]])
    scale = 1.0 / (0.1 * np.concatenate([x.transposed_times(weight), weight @ extra**2, [weight.sum()]]) + pull)

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(x.times(at[:n]) + extra @ at[n : n + k] + at[-1], -30, 30)
        error = weight * (_sigmoid(z) - y)
        off = at - centre
        slope = np.concatenate([x.transposed_times(error), error @ extra, [error.sum()]]) + pull * off
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * pull @ off**2), slope

    at = centre.copy()
    value, slope = loss(at)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, alphas = slope.copy(), []
        for s, g, r in reversed(pairs):
            alphas.append(r * (s @ way))
            way -= alphas[-1] * g
        way *= scale
        for (s, g, r), alpha in zip(pairs, reversed(alphas), strict=True):
            way += s * (alpha - r * (g @ way))
        step, down = 1.0 if pairs else 0.2, slope @ way
        while True:
            new_value, new_slope = loss(at - step * way)
            if new_value <= value - 1e-4 * step * down or step < 1e-4:
                break
            step *= 0.4
        if step < 1e-4:
            break
        s, g = -step * way, new_slope - slope
        if s @ g > 1e-10:
            pairs = [*pairs[-7:], (s, g, 1.0 / (s @ g))]
        done = abs(value - new_value) < 1e-4 * max(1.0, abs(value))
        at, value, slope = at - step * way, new_value, new_slope
        if done:
            break
    return at[:n], at[n : n + k], float(at[-1])


@dataclass
class Chain:
    """A trained chain: feature numbers, weights (features x categories), links between categories, biases."""

    index: dict[str, int]
    weights: np.ndarray
    links: np.ndarray
    bias: np.ndarray
    threshold: float

    def openings(self) -> dict[str, tuple[int, dict[str, int], dict[str, int]]]:
        """By a feature's first word: the word's own number (or -1), the pairs with the next word, those with the next but one."""
        out: dict[str, tuple[int, dict[str, int], dict[str, int]]] = {}
        for f, c in self.index.items():
            words = f.split(" ")
            own = out.get(words[0], (-1, {}, {}))
            if len(words) == 1:
                own = (c, own[1], own[2])
            else:
                own[len(words) - 1][words[-1]] = c
            out[words[0]] = own
        return out

    def score_columns(self, lists: list[list[int]]) -> np.ndarray:
        """Probabilities (segments x categories) from the segments' feature numbers."""
        of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        columns = np.array([c for x in lists for c in x], np.int64)
        out = np.zeros((len(lists), len(CATEGORIES)))
        for c in range(len(CATEGORIES)):
            z = np.bincount(of, self.weights[columns, c], len(lists)) + self.bias[c] + out[:, :c] @ self.links[c, :c]
            out[:, c] = _sigmoid(z)
        return out


def known_columns(tokens: list[str], openings: dict[str, tuple[int, dict[str, int], dict[str, int]]]) -> list[int]:
    """The numbers of a segment's known features; words that begin none cost one look-up."""
    out = []
    for i, token in enumerate(tokens):
        own = openings.get(token)
        if own is not None:
            if own[0] >= 0:
                out.append(own[0])
            if own[1] and i + 1 < len(tokens) and (c := own[1].get(tokens[i + 1])) is not None:
                out.append(c)
            if own[2] and i + 2 < len(tokens) and (c := own[2].get(tokens[i + 2])) is not None:
                out.append(c)
    return out


def telling_features(docs: list[set[str]], label: np.ndarray, seeds: set[str], max_features: int = MAX_FEATURES) -> list[str]:
    """The features that toxic documents hold significantly more often than their share, most telling first, and the seeds.

    A feature counts once per document. It must be at least ``MIN_LEAN`` toxic and ``MIN_Z`` standard errors
    above the share of toxic documents; with few reviewed documents only the seeds remain.
    """
    total: Counter = Counter()
    toxic: dict[str, float] = {}
    for own, y in zip(docs, label.tolist(), strict=True):
        total.update(own)
        if y:
            for f in own:
                toxic[f] = toxic.get(f, 0.0) + y
    base = min(max(float(label.mean()) if len(label) else 0.0, 0.02), 0.9)
    leaning = []
    for f, bad in toxic.items():
        n = total[f]
        z = (bad - base * n) / (base * (1 - base) * n) ** 0.5
        if n >= MIN_DOCS and bad >= MIN_LEAN * n and z >= MIN_Z:
            leaning.append((-z, f))
    leaning.sort()
    return list(dict.fromkeys([*sorted(seeds), *(f for _, f in leaning[:max_features])]))


@dataclass
class _Prepared:
    """What one model of the chain is trained on: known features, the segments by them, weights and targets of the segments."""

    known: set[int]
    x: Rows
    mass: np.ndarray
    target: np.ndarray
    shares: np.ndarray


def category_shares(x: Rows, toxic_mass: np.ndarray, hits: np.ndarray, seed_columns: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Which category the toxic segments belong to: bootstrapped from seed words, by what surrounds them.

    The segments with a seed word begin as that category's; what their *other* features say of the categories is
    learned (the seed words themselves are held out) and assigns all segments anew, those without a seed word included, and so on.
    A segment without other features keeps what its seed words say; one without either belongs to all alike.
    """
    k = hits.shape[1]
    said = hits / np.maximum(hits.sum(1, keepdims=True), 1)
    share = np.where(hits.any(1)[:, None], said, 0.0)
    other = np.ones(x.width)
    other[seed_columns] = 0.0
    context = x.times(other) > 0
    for _ in range(rounds):
        count = np.stack([x.transposed_times(toxic_mass * share[:, c]) for c in range(k)], 1) * other[:, None]
        size = toxic_mass @ share
        likely = np.log((count + 0.5 * size / max(size.sum(), 1e-9) + 1e-3) / (size + 1.0))
        score = np.stack([x.times(likely[:, c] * other) for c in range(k)], 1) + np.log(size + 1.0)
        score -= score.max(1, keepdims=True)
        learned = np.exp(score) / np.exp(score).sum(1, keepdims=True)
        share = np.where(context[:, None], learned, said)
    return np.where(share.sum(1, keepdims=True) > 0, share, 1.0 / k)


def train(texts: list[str], labels: list[float], folds: int = FOLDS, max_features: int = MAX_FEATURES, seed_weight: float = SEED_WEIGHT, held_out: list[float] | None = None) -> Chain:
    """Train the chain on reviewed texts (labels: the reviewers' mean, 0..1). Works with none at all: then the
    seed words decide alone (``seed_weight`` 0 leaves their weights to the labels too).

    Folds are cut by document, equal texts together. For every fold the features are selected, the segments relabelled and
    the categories assigned without its documents, so that the out-of-fold predictions, which later categories get as
    inputs and the threshold is chosen on, have not seen the labels they are compared with. ``held_out`` takes up the
    documents' out-of-fold scores.
    """
    cutter, seeds, certain = Segmenter(), _seeds(), _certain()
    label = np.array(labels, float)
    cut = [sorted({tuple(s) for s in cutter.segments(text)}) for text in texts]
    made = {piece: features(list(piece)) for own in cut for piece in own}
    per_doc = [{f for piece in own for f in made[piece]} for own in cut]
    fold_of = np.array([zlib.crc32(" ".join(" ".join(p) for p in own).encode()) % folds for own in cut], np.int64)
    all_seeds = set().union(*seeds.values())
    chosen = {}
    for k in [*range(folds), folds]:  # the last is trained on all
        kept = [i for i in range(len(cut)) if fold_of[i] != k]
        chosen[k] = telling_features([per_doc[i] for i in kept], label[kept], all_seeds, max_features)
    index = {f: i for i, f in enumerate(dict.fromkeys([*chosen[folds], *(f for own in chosen.values() for f in own)]))}

    # the distinct segments of each fold, by their known features
    numbers: dict[tuple[int, tuple[int, ...]], int] = {}
    by_piece = {piece: tuple(sorted({index[f] for f in own if f in index})) for piece, own in made.items()}
    docs = [sorted({numbers.setdefault((int(k), by_piece[piece]), len(numbers)) for piece in own}) for k, own in zip(fold_of, cut, strict=True)]
    owner = np.array([i for i, own in enumerate(docs) for _ in own], np.int64)
    piece = np.array([p for own in docs for p in own], np.int64)
    n = len(numbers)
    fold = np.array([k for k, _ in numbers], np.int64)
    hits = np.zeros((n, len(SEEDS)), bool)
    priors = np.zeros((len(CATEGORIES), len(index)))
    for c, words in enumerate(seeds.values()):
        own = {index[w] for w in words}
        priors[c, list(own)] = seed_weight
        priors[-1, [index[w] for w in words & certain]] = seed_weight * 1.75
        hits[:, c] = [not own.isdisjoint(columns) for _, columns in numbers]
    seed_columns = np.array(sorted(index[w] for w in all_seeds), np.int64)
    none, verdict = np.zeros((n, 0)), label[owner] if n else label

    def prepare(k: int) -> _Prepared:
        known = {index[f] for f in chosen[k]}
        x = Rows([[c for c in columns if c in known] for _, columns in numbers], len(index))
        used = (fold_of[owner] != k).astype(float)
        mass = np.bincount(piece, used, n)
        target = np.bincount(piece, verdict * used, n) / np.maximum(mass, 1e-9)
        for _ in range(ROUNDS):
            w, _, b = fit_linear(x, none, target, mass, priors[-1])
            toxic = _sigmoid(x.times(w) + b) > 0.5
            # a toxic verdict that another segment explains says nothing about this one
            others = np.bincount(owner, toxic[piece].astype(float), len(docs))[owner] - toxic[piece]
            idle = (others > 0) & ~toxic[piece]
            mass = np.bincount(piece, np.where(idle, 1 - verdict, 1.0) * used, n)
            target = np.bincount(piece, np.where(idle, 0.0, verdict) * used, n) / np.maximum(mass, 1e-9)
        return _Prepared(known, x, mass, target, category_shares(x, mass * target, hits, seed_columns))

    weights = np.zeros((len(index), len(CATEGORIES)))
    links, bias = np.zeros((len(CATEGORIES), len(CATEGORIES))), np.full(len(CATEGORIES), BIAS)
    if not n:
        for c in range(len(CATEGORIES)):
            weights[:, c] = priors[c]
        return Chain(index, weights, links, bias, 0.5)
    ready = [prepare(k) for k in range(folds + 1)]
    oof = np.zeros((n, len(CATEGORIES)))
    for c, name in enumerate(CATEGORIES):
        earlier = oof[:, :c].copy()
        for k, part in enumerate(ready):
            y = part.target if name == "toxic" else part.target * part.shares[:, c]
            w, v, b = fit_linear(part.x, earlier, y, part.mass, priors[c])
            if k < folds:
                mine = fold == k
                oof[mine, c] = _sigmoid(part.x.times(w) + earlier @ v + b)[mine]
            else:
                weights[:, c], links[c, :c], bias[c] = w, v, b
    worst = np.zeros(len(docs))
    np.maximum.at(worst, owner, oof[piece, -1])
    if held_out is not None:
        held_out += worst.tolist()
    return Chain(index, weights, links, bias, best_threshold(worst, label))


def best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The threshold of the best F1 against the reviewers' labels; 0.5 if there are too few to tell."""
    if (label > 0.5).sum() < 20:
        return 0.5
    best = (-1.0, 0.5)
    for t in np.arange(0.3, 0.71, 0.02):
        got = score >= t
        right = float((got * label).sum())
        f1 = 2 * right / max(1e-9, got.sum() + label.sum())
        best = max(best, (round(f1, 4), -abs(t - 0.5)))
        if best == (round(f1, 4), -abs(t - 0.5)):
            chosen = t
    return float(chosen)


def labelled_sample(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[list[str], list[float]]:
    """At most ``limit`` reviewed documents with a text, and the mean of their reviewers' verdicts (abstentions left out)."""
    judged = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("label"))
    sample = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [float(r.label) for r in rows]


def score_documents(documents: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, insult, threat, demeaning, sexual, flagged`` of every document: its worst segment, each.

    Null, empty and blank texts score 0.
    """
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(chain)
    kind = documents.schema[key].dataType.simpleString()
    names = [key, "score", *CATEGORIES[:-1], "flagged"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cutter = shared.value, Segmenter()
        openings, idle = model.openings(), model.score_columns([[]])[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists, owner = [], []
                worst = np.zeros((part.num_rows, len(CATEGORIES)))
                for i, t in enumerate(part.column(1).to_pylist()):
                    own = cutter.segments(t) if t else []
                    if own:
                        worst[i] = idle  # what a segment without known features scores
                    telling = [x for tokens in own if (x := known_columns(tokens, openings))]
                    lists += telling
                    owner += [i] * len(telling)
                if lists:
                    np.maximum.at(worst, np.array(owner), model.score_columns(lists))
                cols = [pa.array(np.round(worst[:, c], 6)) for c in (4, 0, 1, 2, 3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, pa.array(worst[:, 4] >= model.threshold)], names=names)

    schema = f"`{key}` {kind}, score double, " + ", ".join(f"{c} double" for c in CATEGORIES[:-1]) + ", flagged boolean"
    return documents.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
