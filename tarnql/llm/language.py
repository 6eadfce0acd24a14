"""Language identification by a linear-chain conditional random field.

Each word of a text has a label, its language.  A word's features are its
affixes, its inner n-grams and, if it is in the learned lexicon of frequent
words, itself; transitions between neighbouring labels are learned too.
Forward-backward gives each word's label probabilities in its context, which
serves code-switched text; a text's language is the label with the largest sum
of these, its score that sum's share.

The field is fitted on spans of at most ``MAX_TEXTS`` texts, joined to
code-switched sequences.  Texts are then labelled whole; a text of more than
``WINDOW_BYTES`` passes window by window, and the messages between windows carry
its context over, so its length bounds no memory and changes no probability.

Defined cases: null texts, texts without letters and everything where nothing
could be learned get ``und`` with score 0.  Letters without words of the
pattern don't exist: letters are never separators.  Equal sums go to the
language first in order.  Repeated rows are labelled each.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnql.llm import common

#: Texts that the field is fitted on, at most.
MAX_TEXTS = 3000
#: Training sequences, their spans' words and their number of spans.
SEQUENCES, SPAN_WORDS, SPANS = 1200, 15, 4
LEXICON = 1000
TABLE = 1 << 16
EPOCHS, RATE, DECAY = 30, 0.3, 1e-4
#: Words that pass forward-backward at once, and bytes of a longer text's windows, about.
GROUP_WORDS, WINDOW_BYTES = 100_000, 1 << 20

_LETTER = re.compile(rb"[A-Za-z]")
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def features(word: bytes, lexicon: dict[bytes, int]) -> list[int]:
    """Hashed affixes (a mark stands for the word's end) and inner n-grams; a lexicon word is a feature itself."""
    code = zlib.crc32
    n = len(word)
    found = [code(word[:k], 1) for k in (1, 2, 3, 4) if k <= n]
    found += [code(word[-k:], 2) for k in (1, 2, 3, 4) if k <= n]
    found += [code(word[i : i + 3], 3) for i in range(n - 2)]
    found += [code(word[i : i + 2], 4) for i in range(n - 1)]
    if word in lexicon:
        found.append(code(word, 5))
    return [f % TABLE for f in found]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of each word; the sequences lie one after the other in ``scores``.

    Sequences advance together, one word a step; each step is rescaled, so
    sequences of any length stay in range.
    """
    total, k = scores.shape
    if not total:
        return np.zeros((0, k))
    lengths = np.asarray(lengths)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    active = np.bincount(step)  # sequences that have a word at each step; ranks below this number
    begin = np.concatenate([[0], np.cumsum(active)])
    place = begin[step] + np.repeat(rank, lengths)
    e = np.empty((total, k))
    e[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(transitions)
    alpha = np.empty_like(e)
    now = e[: active[0]] * np.exp(start)
    alpha[: active[0]] = now = now / now.sum(axis=1, keepdims=True)
    at = begin.tolist()
    for t in range(1, len(active)):
        now = (now[: at[t + 1] - at[t]] @ a) * e[at[t] : at[t + 1]]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at[t] : at[t + 1]] = now
    beta = np.ones_like(e)
    for t in range(len(active) - 2, -1, -1):
        n = at[t + 2] - at[t + 1]
        after = (beta[at[t + 1] : at[t + 2]] * e[at[t + 1] : at[t + 2]]) @ a.T
        beta[at[t] : at[t] + n] = after / after.sum(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    return both[place]


def _sequences(texts: list[bytes], langs: list[int], k: int, rng: np.random.Generator) -> Iterator[tuple[list[bytes], list[int]]]:
    """Code-switched training sequences: spans from anywhere in the texts, of languages in turn."""
    words = [common.alnum_words(t) for t in texts]
    by_lang = [[i for i, lang in enumerate(langs) if lang == x and words[i]] for x in range(k)]
    there = [x for x in range(k) if by_lang[x]]
    for _ in range(SEQUENCES if there else 0):
        seq, labels = [], []
        for _ in range(rng.integers(1, SPANS + 1)):
            x = there[rng.integers(len(there))]
            own = words[by_lang[x][rng.integers(len(by_lang[x]))]]
            first = rng.integers(max(1, len(own) - SPAN_WORDS + 1))
            part = own[first : first + SPAN_WORDS]
            seq += part
            labels += [x] * len(part)
        yield seq, labels


def fit(texts: list[bytes], langs: list[str]) -> dict | None:
    """Emission weights, transitions and start weights, by AdaGrad on the conditional likelihood."""
    names = sorted(set(langs))
    if not names:
        return None
    k = len(names)
    ids = [names.index(x) for x in langs]
    common_words = Counter(w for t in texts for w in set(common.alnum_words(t)))
    lexicon = {w: n for w, n in sorted(common_words.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]}
    pairs = [p for p in _sequences(texts, ids, k, np.random.default_rng(0)) if p[0]]
    model = {"names": names, "lexicon": lexicon, "weights": np.zeros((TABLE, k)), "transitions": np.zeros((k, k)), "start": np.zeros(k)}
    if not pairs or k == 1:
        return model
    distinct: dict[bytes, int] = {}
    word = np.array([distinct.setdefault(w, len(distinct)) for seq, _ in pairs for w in seq])
    label = np.array([x for _, labels in pairs for x in labels])
    lengths = np.array([len(seq) for seq, _ in pairs])
    per_word = [features(w, lexicon) for w in distinct]
    sizes = np.array([len(f) for f in per_word])
    feature = np.array([f for fs in per_word for f in fs], np.int64)
    owner = np.repeat(np.arange(len(per_word)), sizes)
    gold = np.eye(k)[label]
    first = np.cumsum(lengths) - lengths
    inner = np.setdiff1d(np.arange(len(word)), first)
    squares = [np.full_like(model[x], 1e-6) for x in ("weights", "transitions", "start")]
    for _ in range(EPOCHS):
        by_word = _sums(owner, model["weights"][feature], len(per_word))
        scores = by_word[word]
        p = forward_backward(scores, lengths, model["transitions"], model["start"])
        # neighbours' joint probabilities: from the one-sided messages, by the chain's own factorization
        joint = _joint(scores, lengths, model["transitions"], model["start"], inner)
        per = _sums(word, p - gold, len(per_word))
        grads = [
            _sums(feature, per[owner], TABLE) / len(lengths) + DECAY * model["weights"],
            (joint - gold[inner - 1].T @ gold[inner]) / len(lengths),
            (p - gold)[first].sum(axis=0) / len(lengths),
        ]
        for name, g, s in zip(("weights", "transitions", "start"), grads, squares, strict=True):
            s += g * g
            model[name] -= RATE * g / np.sqrt(s)
    return model


def _sums(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(groups, values[:, x], n) for x in range(values.shape[1])], axis=1)


def _joint(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected transitions: P(y, y') of neighbours summed over all places.

    P(y, y') is P(y | past) a(y, y') e(y') beta(y'), where e beta is P(y') over
    the forward prediction; both come from forward messages and posteriors.
    """
    posterior = forward_backward(scores, lengths, transitions, start)
    a = np.exp(transitions)
    forward = _forward(scores, lengths, a, start)
    ahead = forward[inner - 1] @ a
    ratio = posterior[inner] / np.maximum(ahead, 1e-300)
    return forward[inner - 1].T @ ratio * a


def _forward(scores: np.ndarray, lengths: np.ndarray, a: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.exp(scores - scores.max(axis=1, keepdims=True))
    first = np.cumsum(lengths) - lengths
    now = out[first] * np.exp(start)
    out[first] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, int(lengths.max(initial=0))):
        at = (first + t)[lengths > t]
        now = (out[at - 1] @ a) * out[at]
        out[at] = now / now.sum(axis=1, keepdims=True)
    return out


def window(scores: np.ndarray, transitions: np.ndarray, before: np.ndarray, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Messages through some words of one sequence.

    Without ``after``, the words' forward messages and the one that they send
    on; with the message from behind them, their label probabilities and the
    message that they send back.
    """
    a = np.exp(transitions)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    alpha, now = np.empty_like(e), before
    for t in range(len(e)):
        now = now * e[t]
        alpha[t] = now = now / now.sum()
        now = now @ a
    if after is None:
        return alpha, now / now.sum()
    back = after
    for t in range(len(e) - 1, -1, -1):
        both = alpha[t] * back
        alpha[t] = both / both.sum()
        back = a @ (back * e[t])
        back /= back.sum()
    return alpha, back


def cuts(text: bytes, most: int) -> list[tuple[int, int]]:
    """Where the text is cut between words, into windows of about ``most`` bytes."""
    out, at = [], 0
    while at < len(text):
        found = _SEPARATOR.search(text, at + most)
        to = found.start() if found else len(text)
        out.append((at, to))
        at = to
    return out


class Labeller:
    """Labels words; remembers each word's emission scores."""

    def __init__(self, model: dict | None):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.table = np.zeros((0, len(self.model["names"]) if self.model else 0))

    def _learn(self, words: list[bytes]) -> None:
        per_word = [features(w, self.model["lexicon"]) for w in words]
        owner = np.repeat(np.arange(len(words)), [len(f) for f in per_word])
        feature = np.array([f for fs in per_word for f in fs], np.int64)
        for w in words:
            self.known[w] = len(self.known)
        self.size += sum(map(len, words)) + common.ENTRY_BYTES * len(words)
        self.table = np.concatenate([self.table, _sums(owner, self.model["weights"][feature], len(words))])

    def _emissions(self, words: list[list[bytes]]) -> np.ndarray:
        if self.size > common.MEMORY_BYTES:
            self._clear()
        known = self.known
        if new := sorted({w for ws in words for w in ws if w not in known}):
            self._learn(new)
        return self.table[np.array([known[w] for ws in words for w in ws], np.int64)]

    def probabilities(self, words: list[list[bytes]]) -> list[np.ndarray]:
        """Each word's label probabilities, text by text."""
        lengths = np.array([len(ws) for ws in words], np.int64)
        p = forward_backward(self._emissions(words), lengths[lengths > 0], self.model["transitions"], self.model["start"])
        return np.split(p, np.cumsum(lengths)[:-1]) if len(words) else []

    def windows(self, text: bytes, most: int | None = None) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """The words and probabilities of a long text's windows, last one first."""
        places = cuts(text, most or WINDOW_BYTES)
        before = [np.exp(self.model["start"])]
        for x, y in places[:-1]:
            words = common.alnum_words(text[x:y])
            before.append(window(self._emissions([words]), self.model["transitions"], before[-1])[1] if words else before[-1])
        after = np.ones(len(self.model["names"]))
        for (x, y), message in zip(places[::-1], before[::-1], strict=True):
            if words := common.alnum_words(text[x:y]):
                p, after = window(self._emissions([words]), self.model["transitions"], message, after)
                yield words, p

    def __call__(self, texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray | None]]:
        """Each text's words and their probabilities; None where there is nothing to label."""
        for parts in self.parts(texts):
            parts = parts[::-1] if isinstance(parts, list) else list(parts)[::-1]
            got = [p for _, p in parts if p is not None]
            yield [w for ws, _ in parts for w in ws], np.concatenate(got) if got else None

    def parts(self, texts: list[bytes | None]) -> Iterator[Iterator[tuple[list[bytes], np.ndarray | None]]]:
        """Each text's windows, last one first; most texts are one."""
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            long = text is not None and len(text) > WINDOW_BYTES
            if long and self.model and has_letter(text):
                yield from self._flush(group)
                yield self.windows(text)
                group, size = [], 0
                continue
            own = common.alnum_words(text) if self.model and has_letter(text) else []
            group.append(own)
            size += len(own)
            if size >= GROUP_WORDS:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[bytes]]) -> Iterator[list[tuple[list[bytes], np.ndarray | None]]]:
        if not any(group):
            yield from ([(ws, None)] for ws in group)
            return
        for ws, p in zip(group, self.probabilities(group), strict=True):
            yield [(ws, p if len(ws) else None)]


def held_out() -> F.Column:
    """Whether nothing may be learned from the row: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, most: int = MAX_TEXTS) -> dict | None:
    """The field of at most ``most`` texts with a language, chosen by their id's hash."""
    chosen = (
        docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .select("doc_id", "lang")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "lang")
        .limit(most)
    )
    rows = (
        docs.select("doc_id", "text", "lang")
        .join(F.broadcast(chosen), ["doc_id", "lang"])  # at most ``most`` ids
        .filter(F.col("text").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(most)
        .select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
        .collect()
    )
    return fit([bytes(r["text"]) for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: dict | None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs``, with the language of ``text`` and its score."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def each(texts: list[bytes | None]) -> dict:
        labels, scores = [], []
        for parts in common.remembered(key, lambda: Labeller(shared.value)).parts(texts):
            sums, n = 0.0, 0
            for ws, p in parts:
                if p is not None:
                    sums, n = sums + p.sum(axis=0), n + len(ws)
            share = sums / n if n else None
            labels.append("und" if share is None else shared.value["names"][int(share.argmax())])
            scores.append(0.0 if share is None else float(min(1.0, share.max())))
        return {label: labels, score: scores}

    return common.with_columns(docs, "text", each, f"{label} string, {score} double")


def label_words(docs: DataFrame, model: dict | None) -> DataFrame:
    """All rows and columns of ``docs``, with the words of ``text``, their languages and probabilities."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def each(texts: list[bytes | None]) -> dict:
        words, langs, probs = [], [], []
        for ws, p in common.remembered(key, lambda: Labeller(shared.value))(texts):
            words.append([w.decode("utf-8", "replace") for w in ws])
            langs.append([] if p is None else [shared.value["names"][i] for i in p.argmax(axis=1)])
            probs.append([] if p is None else p.max(axis=1).tolist())
        return {"words": words, "word_langs": langs, "word_probs": probs}

    return common.with_columns(docs, "text", each, "words array<string>, word_langs array<string>, word_probs array<double>")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
