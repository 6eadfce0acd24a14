"""Token counts under a unigram model, by dynamic programming over a shared trie.

A pre-token is a word between blanks, with the pieces' word mark before it.
Its best segmentation maximizes the sum of its pieces' scores (a character
outside all pieces costs its UTF-8 bytes, one token each); among equals, the
one with fewer tokens counts.  A batch's distinct pre-tokens form a trie: they
are visited in order, and each prefix's forward scores are computed once for
all the pre-tokens below it.  Terminal counts are remembered, and a document's
count is the sum over its pre-tokens.

Scores come from the pieces' ranks by Zipf's law, so any ranked public
vocabulary serves; the vocabulary is a parameter.

Defined cases: null and empty texts have no tokens.  Repeated rows are counted
each.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tarnql.llm import common

#: Stands for the blank before a word, in the public pieces; a fixed value.
WORD_MARK = "▁"

def zipf_scores(pieces: Iterable[str]) -> dict[str, float]:
    """Log probabilities of ranked pieces."""
    ranked = list(dict.fromkeys(pieces))
    norm = math.log(sum(1 / (r + 2) for r in range(len(ranked)))) if ranked else 0.0
    return {p: -math.log(r + 2) - norm for r, p in enumerate(ranked)}


class Counter:
    """Counts of pre-tokens' best segmentations."""

    def __init__(self, scores: dict[str, float]):
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = score
        self.byte_score = min(scores.values(), default=0.0) - 10.0
        self.known: dict[str, int] = {}
        self.size = 0  # bytes that the counts take, about

    def learn(self, words: Iterable[str]) -> None:
        """Counts of new pre-tokens, prefix by prefix in sorted order."""
        root, byte_score = self.root, self.byte_score
        # at depth i: best (score, -tokens) of the prefix, and the pieces' trie nodes that end there with their starts
        best: list[tuple[float, int]] = [(0.0, 0)]
        alive: list[list[tuple[int, dict]]] = [[]]
        before = ""
        for word in sorted(words):
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del best[depth + 1 :], alive[depth + 1 :]
            for i in range(depth, len(word)):
                c = word[i]
                n = len(c.encode("utf-8", "surrogatepass"))
                score, tokens = best[i]
                top = (score + n * byte_score, tokens - n)
                nodes = []
                for start, node in (*alive[i], (i, root)):
                    if (node := node.get(c)) is not None:
                        nodes.append((start, node))
                        if None in node:
                            score, tokens = best[start]
                            if (found := (score + node[None], tokens - 1)) > top:
                                top = found
                best.append(top)
                alive.append(nodes)
            self.known[word] = -best[len(word)][1]
            self.size += len(word) + common.ENTRY_BYTES
            before = word

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Each text's tokens and pre-tokens."""
        known = self.known
        if self.size > common.MEMORY_BYTES:
            known.clear()
            self.size = 0
        words = [[WORD_MARK + w for w in text.split()] if text else [] for text in texts]
        self.learn({w for ws in words for w in ws if w not in known})
        return [sum(map(known.__getitem__, ws)) for ws in words], [len(ws) for ws in words]


def counter(path: str) -> Counter:
    """Of the pieces of a public sentencepiece model, by rank; its control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = sorted((-model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return Counter(zipf_scores(model.id_to_piece(i) for _, i in ranked))


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """All rows and columns of ``docs``, with n_tokens and n_pretokens of ``text``."""

    def each(texts: list[bytes | None]) -> dict:
        own, tokens, words = common.remembered(f"token_counts {model_path}", lambda: counter(model_path)), [], []
        part: list[str | None] = []
        size = 0
        for i, text in enumerate(texts):
            part.append(None if text is None else text.decode("utf-8", "replace"))
            size += len(text or b"")
            if size >= 1 << 20 or i == len(texts) - 1:
                a, b = own.count(part)
                tokens += a
                words += b
                part, size = [], 0
        return {"n_tokens": tokens, "n_pretokens": words}

    return common.with_columns(docs, "text", each, "n_tokens long, n_pretokens long")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, default_model()).drop("text")
