"""Language identification of words by a linear-chain conditional random field.

Each word has features: its affixes of one to three letters, its letter bigrams and trigrams with
word boundaries, and its own form if the lexicon of the training texts has it. Their weights, and
the weights of transitions between the languages of neighbouring words, are learnt together by
maximum likelihood; training sequences are cut from labelled texts, some spliced from texts of
several languages, so that transitions learn when texts switch. Forward-backward gives every word
of a text its probability for each language; a document gets the language with the largest mean
over its letters.

The fit uses ``sample`` different labelled texts of each language at most, ``TEXTS`` in all, those with the smallest
hashes of id and text, of ``SAMPLE_BYTES`` at most each, and the ``LANGS`` languages with the most rows. These bounds hold
for the fit alone: every text is labelled, whole, whatever its length.

Defined results: ``und`` with score 0 for a null text or one without letters, and for all texts if
nothing can be learnt; of languages with equal shares of a text the first by name. Empty tables give empty results;
repeated rows repeated results; further columns play no part.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cache, caches_of, held_out, small_batches

#: Bounds of what the driver fits on: texts of a language, bytes of one of them, texts in all, languages.
SAMPLE, SAMPLE_BYTES, TEXTS, LANGS = 400, 65536, 8000, 200
#: Words of a training sequence, sequences cut from a text, forms in the lexicon, hashed features.
SPAN, CUTS, LEXICON, BUCKETS = 40, 6, 20_000, 1 << 17
UNKNOWN = "und"
#: Forms whose scores a worker keeps (some 160 bytes each), words scanned at once, words of a block of the scan, and feature names kept.
FORMS, GROUP, BLOCK, GRAMS = 250_000, 100_000, 64, 100_000
_SPLICED = 0.35


_buckets = Cache(lambda name: zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS, GRAMS)


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


def features(letters: str, lexicon: set[str]) -> list[int]:
    """Hashed features of a word's letters."""
    if not letters:
        return []
    p, w = f"^{letters}$", letters
    names = ["p" + w[:1], "p" + w[:2], "p" + w[:3], "s" + w[-1:], "s" + w[-2:], "s" + w[-3:]]
    n = len(p)
    names += [p[i : i + 2] for i in range(n - 1)]
    names += [p[i : i + 3] for i in range(n - 2)]
    if w in lexicon:
        names.append(f"w {w}")
    return [*map(_buckets.__getitem__, names)]


@dataclass
class CrfModel:
    langs: list[str]
    weights: np.ndarray  # features x languages
    trans: np.ndarray
    start: np.ndarray
    lexicon: set[str] = field(default_factory=set)

    def __post_init__(self):
        self._fresh()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_scores", "_letters", "_uses")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fresh()

    def _fresh(self) -> None:
        self._known: dict[str, int] = {}
        self._scores = np.zeros((1024, len(self.langs)), dtype=np.float32)
        self._letters = np.zeros(1024, dtype=np.float32)
        self._uses = np.zeros(1024, dtype=np.float32)

    def take_turn(self) -> None:
        """Before a task: other operators' and other models' caches go."""
        if _live and _live[0] is not self:
            _live[0]._fresh()
        _live[:] = [self]
        caches_of("langid", _forget)

    def _age(self) -> None:
        """Keeps the half of the forms that were used most, of late above all."""
        n = len(self._known)
        stay = np.sort(np.argpartition(-self._uses[:n], FORMS // 2)[: FORMS // 2])
        names = list(self._known)
        self._known = {names[i]: k for k, i in enumerate(stay.tolist())}
        for part in (self._scores, self._letters, self._uses):
            part[: len(stay)] = part[stay]
        self._uses[: len(stay)] /= 2
        self._uses[len(stay) :] = 0

    def _learn_forms(self, words: list[str]) -> None:
        """Scores of new forms, all at once."""
        at, end = len(self._known), len(self._known) + len(words)
        while end > len(self._scores):
            self._scores = np.vstack([self._scores, np.zeros_like(self._scores)])
            self._letters = np.concatenate([self._letters, np.zeros_like(self._letters)])
            self._uses = np.concatenate([self._uses, np.zeros_like(self._uses)])
        clean = [*map(letters_of, words)]
        found = [features(w, self.lexicon) for w in clean]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self._letters[at:end] = np.fromiter(map(len, clean), np.float32, len(clean))
        full = np.flatnonzero(lens)
        if len(full):
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(lens.sum()))
            starts = np.concatenate([[0], np.cumsum(lens[full])[:-1]])
            self._scores[at + full] = np.add.reduceat(self.weights[flat], starts, axis=0) / np.sqrt(lens[full])[:, None]
        self._scores[at + np.flatnonzero(lens == 0)] = 0
        self._known.update(zip(words, range(at, end), strict=True))

    def _forms(self, words: list[str]) -> np.ndarray:
        self._learn_forms([*set(words).difference(self._known)])
        return np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))

    def posteriors(self, words: list[str], opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each word's languages, and its letters; ``opens``: where texts begin."""
        if len(self._known) > FORMS:
            self._age()
        form = self._forms(words)
        self._uses[: len(self._known)] += np.bincount(form, minlength=len(self._known))
        return forward_backward(self._scores[form], opens, self.trans, self.start), self._letters[form]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        """For each text: language, score, words, switches between neighbouring words."""
        out: list[tuple[str, float, int, int]] = []
        group: list[list[str]] = []
        size = 0
        for text in [*texts, ...]:
            words = [] if text is ... or not text else text.split()
            if group and (text is ... or size + len(words) > GROUP):
                out += self._label_group(group)
                group, size = [], 0
            if text is not ...:
                group.append(words)
                size += len(words)
        return out

    def _label_group(self, group: list[list[str]]) -> list[tuple[str, float, int, int]]:
        full = [(i, w) for i, w in enumerate(group) if w]
        out = [(UNKNOWN, 0.0, len(w), 0) for w in group]
        if not full or not self.langs:
            return out
        at = np.cumsum([0] + [len(w) for _, w in full[:-1]])
        opens = np.zeros(sum(len(w) for _, w in full), dtype=bool)
        opens[at] = True
        post, letters = self.posteriors([x for _, w in full for x in w], opens)
        best = post.argmax(axis=1)
        turns = (best[1:] != best[:-1]) & ~opens[1:] if len(best) > 1 else np.zeros(0, bool)
        turns = np.add.reduceat(np.concatenate([[0], turns]), at)
        share = np.add.reduceat(post * letters[:, None], at, axis=0)
        total = np.add.reduceat(letters, at)
        for k, (i, w) in enumerate(full):
            if total[k] > 0:
                lang = int(share[k].argmax())
                out[i] = (self.langs[lang], float(min(1.0, share[k, lang] / total[k])), len(w), int(turns[k]))
        return out

    def word_labels(self, text: str | None) -> list[tuple[str, str]]:
        """Each word of one text with its likeliest language."""
        words = (text or "").split()
        if not words or not self.langs:
            return [(w, UNKNOWN) for w in words]
        opens = np.zeros(len(words), dtype=bool)
        opens[0] = True
        post, letters = self.posteriors(words, opens)
        return [(w, self.langs[k] if n else UNKNOWN) for w, k, n in zip(words, post.argmax(axis=1).tolist(), letters.tolist(), strict=True)]


_live: list[CrfModel] = []


def _forget() -> None:
    _buckets.forget()
    for model in _live:
        model._fresh()


def forward_backward(score: np.ndarray, opens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of a chain of many texts, all blocks of ``BLOCK`` words at the same time.

    A text's first word forgets what came before. First each block's product of transition
    matrices is taken, then messages pass from block to block, then through each block.
    """
    n, k = score.shape
    blocks = -(-n // BLOCK)
    psi = np.zeros((blocks * BLOCK, k), dtype=np.float32)
    psi[:n] = np.exp(score - score.max(axis=1, keepdims=True))
    psi[n:] = 1
    fresh = np.zeros(blocks * BLOCK, dtype=bool)
    fresh[:n], fresh[n:] = opens, True
    psi, fresh = psi.reshape(blocks, BLOCK, k), fresh.reshape(blocks, BLOCK)
    a, pi = np.exp(trans - trans.max()).astype(np.float32), np.exp(start - start.max()).astype(np.float32)

    whole = np.tile(np.eye(k, dtype=np.float32), (blocks, 1, 1))
    for t in range(BLOCK):
        step = (whole.reshape(-1, k) @ a).reshape(blocks, k, k)
        f = fresh[:, t]
        if f.any():
            step[f] = whole[f].sum(axis=2, keepdims=True) * pi
        step *= psi[:, t, None, :]
        whole = step / step.max(axis=(1, 2), keepdims=True)
    into = np.empty((blocks, k), dtype=np.float32)
    message = np.full(k, 1 / k, dtype=np.float32)
    for b in range(blocks):
        into[b] = message
        message = message @ whole[b]
        message /= message.sum()
    back = np.empty((blocks, k), dtype=np.float32)
    message = np.ones(k, dtype=np.float32)
    for b in range(blocks - 1, -1, -1):
        back[b] = message
        message = whole[b] @ message
        message /= message.max()

    alpha = np.empty_like(psi)
    now = into
    for t in range(BLOCK):
        f = fresh[:, t, None]
        now = np.where(f, pi, now @ a) * psi[:, t]
        now /= now.sum(axis=1, keepdims=True)
        alpha[:, t] = now
    now = back
    for t in range(BLOCK - 1, -1, -1):
        alpha[:, t] *= now
        seen = psi[:, t] * now
        now = np.where(fresh[:, t, None], (seen * pi).sum(axis=1, keepdims=True), seen @ a.T)
        now /= now.max(axis=1, keepdims=True)
    post = alpha.reshape(-1, k)[:n]
    return post / post.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 4, seed: int = 7) -> CrfModel:
    """Maximum likelihood with a small ridge, by AdaGrad over batches of training sequences."""
    names = sorted(set(langs))
    if not names:
        return CrfModel([], np.zeros((1, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    rnd = random.Random(seed)
    pool: dict[int, list[list[str]]] = {i: [] for i in range(len(names))}
    counts: Counter[str] = Counter()
    for text, lang in zip(texts, langs, strict=True):
        words = [w for w in text.split() if any(map(str.isalpha, w))]
        for c in range(min(CUTS, -(-len(words) // SPAN))):
            at = rnd.randrange(max(1, len(words) - SPAN + 1))
            cut = words[at : at + SPAN]
            pool[names.index(lang)].append(cut)
            counts.update(map(letters_of, cut))
    lexicon = {w for w, n in counts.most_common(LEXICON) if n > 2 and w}
    known = [i for i in pool if pool[i]]
    model = CrfModel(names, np.zeros((BUCKETS, len(names)), np.float32), np.zeros((len(names),) * 2), np.zeros(len(names)), lexicon)
    if len(known) < 2:
        return model
    sequences = []
    per = max(len(p) for p in pool.values())
    for i in known:
        for j in range(min(per, 6 * len(pool[i]))):
            words, labels = list(pool[i][j % len(pool[i])]), []
            labels = [i] * len(words)
            if rnd.random() < _SPLICED:
                other = rnd.choice([x for x in known if x != i])
                guest = rnd.choice(pool[other])
                at, size = rnd.randrange(len(words) + 1), rnd.randint(3, SPAN)
                words, labels = words[:at] + guest[:size] + words[at:], labels[:at] + [other] * len(guest[:size]) + labels[at:]
            sequences.append((words[:SPAN], labels[:SPAN]))
    index: dict[str, int] = {}
    rows: list[np.ndarray] = []
    for words, _ in sequences:
        for w in words:
            if w not in index:
                index[w] = len(rows)
                rows.append(np.array(features(letters_of(w), lexicon), dtype=np.int64))
    w, trans, start = np.zeros((BUCKETS, len(names))), np.zeros((len(names),) * 2), np.zeros(len(names))
    gw, gt, gs = np.full(w.shape, 1e-2), np.full(trans.shape, 1e-2), np.full(start.shape, 1e-2)
    for epoch in range(epochs):
        rnd.shuffle(sequences)
        for b in range(0, len(sequences), 64):
            part = [s for s in sequences[b : b + 64] if s[0]]
            ids = [index[x] for words, _ in part for x in words]
            gold = np.array([y for _, labels in part for y in labels])
            opens = np.zeros(len(ids), dtype=bool)
            opens[np.cumsum([0] + [len(x) for x, _ in part[:-1]])] = True
            feats = [rows[i] for i in ids]
            lens = np.array([len(f) for f in feats])
            flat, owner = np.concatenate(feats), np.repeat(np.arange(len(ids)), lens)
            scale = 1 / np.sqrt(lens)
            score = np.add.reduceat(w[flat], np.concatenate([[0], np.cumsum(lens)[:-1]]), axis=0) * scale[:, None]
            post, pairs = _expected(score, opens, trans, start)
            error = post.copy()
            error[np.arange(len(gold)), gold] -= 1
            size = len(part)
            own, place = np.unique(flat, return_inverse=True)
            g = np.zeros((len(own), len(names)))
            np.add.at(g, place, (error * scale[:, None])[owner])
            g = g / size + 1e-5 * w[own]
            gw[own] += g * g
            w[own] -= 0.5 * g / np.sqrt(gw[own])
            inner = ~opens[1:]
            real = np.zeros_like(trans)
            np.add.at(real, (gold[:-1][inner], gold[1:][inner]), 1)
            g = (pairs - real) / size + 1e-3 * trans
            gt += g * g
            trans -= 0.3 * g / np.sqrt(gt)
            g = error[opens].sum(axis=0) / size + 1e-3 * start
            gs += g * g
            start -= 0.3 * g / np.sqrt(gs)
    return CrfModel(names, w.astype(np.float32), trans, start, lexicon)


def _expected(score: np.ndarray, opens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of words, and the expected number of each transition, of a batch of sequences."""
    at = np.flatnonzero(opens)
    lens = np.diff([*at, len(opens)])
    b, t, k = len(at), int(lens.max()), score.shape[1]
    psi = np.ones((b, t, k))
    live = np.arange(t)[None, :] < lens[:, None]
    psi[live] = np.exp(score - score.max(axis=1, keepdims=True))
    a, pi = np.exp(trans - trans.max()), np.exp(start - start.max())
    alpha, beta = np.empty((b, t, k)), np.ones((b, t, k))
    now = pi * psi[:, 0]
    alpha[:, 0] = now / now.sum(axis=1, keepdims=True)
    for i in range(1, t):
        now = (alpha[:, i - 1] @ a) * psi[:, i]
        alpha[:, i] = now / now.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        now = (beta[:, i + 1] * psi[:, i + 1]) @ a.T
        beta[:, i] = np.where(live[:, i + 1, None], now / now.max(axis=1, keepdims=True), 1)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pairs = alpha[:, :-1, :, None] * a * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    return post[live], (pairs * live[:, 1:, None, None]).sum(axis=(0, 1))


def fit_on(docs: DataFrame, sample: int = SAMPLE) -> CrfModel:
    """Fits on rows with a language outside the held-out fold, ``sample`` different ones of each at most."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    most = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("id", "text")).alias("kinds")).orderBy(F.desc("n"), "lang").limit(LANGS)
    counts = {r["lang"]: max(1, r["kinds"]) for r in most.collect()}
    if not counts:
        return fit([], [])
    sample = max(1, min(sample, TEXTS // len(counts)))
    # a draw that finds twice as many as are wanted, then the first ones of it; repeated rows are folded before they meet
    steps = 1 << 40
    limit = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(steps, -(-steps * 2 * sample // n))))])
    h = F.xxhash64("id", "text")
    drawn = rows.where((F.pmod(h, F.lit(steps)) < limit[F.col("lang")]) & (F.octet_length("text") <= SAMPLE_BYTES)).select("lang", h.alias("h"), "id", "text")
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(steps)), "h")
    chosen = drawn.groupBy("lang", "h").agg(F.min(F.struct("id", "text")).alias("r")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample)
    got = sorted(chosen.select("r.id", "r.text", "lang").collect(), key=lambda r: (r["id"], r["text"], r["lang"]))  # sample texts a language
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: CrfModel) -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_switches for every row; text alone enters them."""
    schema = "doc_id long, lang_pred string, score double, n_words long, n_switches long"
    kinds = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("n_switches", pa.int64())])
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        own.take_turn()
        for batch in batches:
            found = list(zip(*own.label(batch.column(1).to_pylist()), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(found, list(kinds)[1:], strict=True))], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: CrfModel, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is one of the learnt ones, at ``least`` certain; their own columns.

    If none could be learnt, all texts with letters stay.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        sent.value.take_turn()
        if not sent.value.langs:
            return pd.Series([any(map(str.isalpha, t or "")) for t in text.tolist()], dtype=bool)
        return pd.Series([lang != UNKNOWN and score >= least for lang, score, _, _ in sent.value.label(text.tolist())], dtype=bool)

    return docs.where(known(F.col("text").cast("string")))
