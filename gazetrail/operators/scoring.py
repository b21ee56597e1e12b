"""Scores by neural models: what a model must offer, and the relational half around it.

A model encodes text to ids and gives scores of all ids at a place.  `Causal` and `Masked` turn the words of a
sentence into token rows with log probabilities in nats; weights are loaded once for each Python worker by
the factory that makes them.  What tokens belong to which word, the sums, the units and what cannot be scored are
joins and aggregates here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetrail.functions.numeric import nats_to_bits
from gazetrail.functions.text import sentence_key, word_spans
from gazetrail.operators import joins, sentence
from gazetrail.operators.projections import feature_name

#: word_index says whose a token is; where it is null, the words that the token's span overlaps.
TOKENS = "sentence_id string, token_index int, word_index int, start int, end int, logprob double"


SENTENCES = 256  # whose token rows are handed on together


def batched(rows: Iterable, size: int) -> Iterator[list]:
    """Lists of `size`, the last maybe shorter."""
    rest = iter(rows)
    while part := list(islice(rest, size)):
        yield part


class Model(Protocol):
    begin: int | None  # the id that opens a sequence of a causal model
    mask: int | None  # the id that hides a token from a masked one

    def encode(self, text: str) -> list[int]:
        """ids of a text, nothing added."""

    def encode_with_spans(self, text: str, max_length: int) -> tuple[list[int], list[tuple[int, int]]]:
        """ids of a text with those that frame it, `max_length` at most, and the characters each stands for, (0, 0) for the frame's."""

    def scores(self, ids: list[int], places: list[int]) -> np.ndarray:
        """A row of scores of all ids for each place: of a causal model for what follows there, of a masked one for what stands there."""


#: Two things that a model may offer besides, which cost less where they hold.  `additive`: the ids of words joined by spaces are
#: those of the first word and of each other with its space, so one pass over a sentence scores all its words (a causal
#: model's scores at a place depend on nothing behind it).  `scores_each(rows, places)`: a row of scores for one place of each of
#: several sequences of one length.


def log_softmax(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=-1, keepdims=True)
    return scores - top - np.log(np.exp(scores - top).sum(axis=-1, keepdims=True))


class Causal:
    """Each word's tokens given the words before it: a word is encoded with the space before it, apart from its prefix."""

    def __init__(self, model: Model):
        self.model = model

    def tokens(self, words: list[str]) -> list[tuple]:
        """(word_index, start, end, log probability) of each token; a word without tokens or context has none."""
        out, begin = [], [] if self.model.begin is None else [self.model.begin]
        if getattr(self.model, "additive", False):
            return self._at_once(words, begin)
        for i, word in enumerate(words):
            prefix = " ".join(words[:i])
            context = begin + (self.model.encode(prefix) if prefix else [])
            own = self.model.encode(f" {word}" if prefix else word)
            if not own or not context:
                continue
            places = list(range(len(context) - 1, len(context) + len(own) - 1))
            p = log_softmax(np.asarray(self.model.scores(context + own, places), float))
            out += [(i, None, None, float(p[k, x])) for k, x in enumerate(own)]
        return out

    def _at_once(self, words: list[str], begin: list[int]) -> list[tuple]:
        """The same of an additive model: linear in the sentence, where a prefix for each word costs its square."""
        ids, of = list(begin), [-1] * len(begin)
        opened = False  # whether a word before has characters: from there on words have a space before them
        scored = []
        for i, word in enumerate(words):
            opened = opened or i > 1 or (i == 1 and words[0] != "")
            own = self.model.encode(f" {word}" if opened else word)
            if own and ids:
                scored += range(len(ids), len(ids) + len(own))
            ids += own
            of += [i] * len(own)
        if not scored:
            return []
        p = log_softmax(np.asarray(self.model.scores(ids, [k - 1 for k in scored]), float))
        found = p[np.arange(len(scored)), [ids[k] for k in scored]].tolist()
        return [(of[k], None, None, x) for k, x in zip(scored, found)]


class Masked:
    """Each token of a sentence given all others, itself hidden; what the model's length cuts off is not scored."""

    def __init__(self, model: Model, max_length: int = 512):
        if model.mask is None:
            raise ValueError("the model has no mask")
        self.model, self.max_length = model, max_length

    def tokens(self, words: list[str]) -> list[tuple]:
        """(None, start, end, log probability) of each token of the words joined by spaces."""
        ids, spans = self.model.encode_with_spans(" ".join(words), self.max_length)
        out = []
        if hasattr(self.model, "scores_each"):
            places = [k for k, ab in enumerate(spans) if ab != (0, 0)]
            p = {}
            if places:
                hidden = np.tile(np.asarray(ids), (len(places), 1))
                hidden[np.arange(len(places)), places] = self.model.mask
                found = log_softmax(np.asarray(self.model.scores_each(hidden, places), float))
                p = dict(zip(places, found[np.arange(len(places)), [ids[k] for k in places]].tolist()))
            return [(None, a, b, p.get(k)) for k, (a, b) in enumerate(spans)]
        for k, (a, b) in enumerate(spans):
            p = None
            if (a, b) != (0, 0):
                hidden = [*ids[:k], self.model.mask, *ids[k + 1 :]]
                p = float(log_softmax(np.asarray(self.model.scores(hidden, [k]), float))[0, ids[k]])
            out.append((None, a, b, p))
        return out


class StandIn:
    """A made-up model of 64 ids, to show what is computed around a model and nothing about language.

    Words are cut into pieces of four characters; scores follow from the ids beside a place by a fixed rule."""

    begin, first, last, mask, size, width, additive = 0, 1, 2, 3, 64, 4, True

    def __init__(self, masked: bool = False):
        self.masked = masked

    def _pieces(self, text: str) -> list[tuple[int, int, int]]:
        out, at = [], 0
        for word in text.split(" "):
            for a in range(0, len(word), self.width):
                piece = word[a : a + self.width]
                out.append((4 + (ord(piece[0]) * 3 + len(piece)) % 60, at + a, at + a + len(piece)))
            at += len(word) + 1
        return out

    def encode(self, text: str) -> list[int]:
        return [x for x, *_ in self._pieces(text)]

    def encode_with_spans(self, text: str, max_length: int) -> tuple[list[int], list[tuple[int, int]]]:
        kept = self._pieces(text)[: max(0, max_length - 2)]
        return [self.first, *(x for x, *_ in kept), self.last], [(0, 0), *((a, b) for _, a, b in kept), (0, 0)]

    def scores(self, ids: list[int], places: list[int]) -> np.ndarray:
        beside = [13 * ids[k - 1] + 5 * ids[k + 1] if self.masked else 13 * ids[k] for k in places]
        return self._rows(np.array(beside, int))

    def scores_each(self, rows: np.ndarray, places: list[int]) -> np.ndarray:
        at, k = np.arange(len(places)), np.asarray(places)
        return self._rows(13 * rows[at, k - 1] + 5 * rows[at, k + 1] if self.masked else 13 * rows[at, k])

    def _rows(self, beside: np.ndarray) -> np.ndarray:
        return (7 * np.arange(self.size) + beside[:, None]) % 16 / 4


class Pretrained:
    """A model of the transformers library, by name or folder."""

    def __init__(self, name: str, masked: bool = False, device: str | None = None):
        import torch
        import transformers

        self.torch, kind = torch, transformers.AutoModelForMaskedLM if masked else transformers.AutoModelForCausalLM
        self.device = device or ("cuda" if torch.cuda.is_available() else "cpu")
        self.codes = transformers.AutoTokenizer.from_pretrained(name, use_fast=True)
        self.net = kind.from_pretrained(name).to(self.device).eval()
        self.begin = self.codes.eos_token_id if self.codes.bos_token_id is None else self.codes.bos_token_id
        self.mask = self.codes.mask_token_id

    def encode(self, text: str) -> list[int]:
        return self.codes(text, add_special_tokens=False)["input_ids"]

    def encode_with_spans(self, text: str, max_length: int) -> tuple[list[int], list[tuple[int, int]]]:
        got = self.codes(text, truncation=True, max_length=max_length, return_offsets_mapping=True)
        return got["input_ids"], [tuple(x) for x in got["offset_mapping"]]

    def scores(self, ids: list[int], places: list[int]) -> np.ndarray:
        with self.torch.inference_mode():
            out = self.net(input_ids=self.torch.tensor([ids], device=self.device)).logits[0, places]
        return out.float().cpu().numpy()


def token_scores(sentences: DataFrame, factory: Callable[[], Causal | Masked]) -> DataFrame:
    """(sentence_id, ws: its words) -> token rows, with one scorer for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for b in batches:
            for some in batched(zip(b["sentence_id"], b["ws"]), SENTENCES):
                rows = [(s, i, *t) for s, words in some for i, t in enumerate(scorer.tokens(list(words)))]
                out = pd.DataFrame(rows, columns=["sentence_id", "token_index", "word_index", "start", "end", "logprob"])
                yield out.astype({c: "Int32" for c in ("token_index", "word_index", "start", "end")} | {"logprob": "float64"})

    return sentences.select(sentence_key(F.col("sentence_id")).alias("sentence_id"), "ws").dropna("any").mapInPandas(run, TOKENS)


def word_sums(tokens: DataFrame, words: DataFrame, unit: str = "bits", name: str = "score") -> DataFrame:
    """(sentence_id, word_index, score): surprisal summed over the tokens of each word; null without any that is scored."""
    scored = tokens.filter("logprob is not null")
    met = joins.span_overlaps(scored.filter("word_index is null").drop("word_index"), words).select("sentence_id", "word_index", "logprob")
    met = met.unionByName(scored.filter("word_index is not null").select("sentence_id", "word_index", "logprob"))
    total = F.sum(-F.col("logprob"))
    summed = met.groupBy("sentence_id", "word_index").agg((nats_to_bits(total) if unit == "bits" else total).alias(name))
    return words.select("sentence_id", "word_index").join(summed, ["sentence_id", "word_index"], "left")


def model_surprisal(df: DataFrame, factory: Callable[[], Causal | Masked], model: str, suffix: str = "surprisal", max_sentences: int | None = None, unit: str = "bits", word: str = "word_clean", order: str = "_row_ord") -> DataFrame:
    """Key columns of `df` with the model's score of each word; each sentence is scored once for all readers.
    Sentences beyond the first `max_sentences` have null scores."""
    name = feature_name(model, suffix)
    items = sentence.dedup_first(df.filter("sentence_id is not null"), ["sentence_id", "position_in_sentence"], [order])
    if max_sentences is not None:
        items = items.join(sentence.first_sentences(items, max_sentences, "sentence_id", order), "sentence_id", "left_semi")
    packed = F.array_sort(F.collect_list(F.struct(F.col("position_in_sentence").cast("int").alias("p"), F.col("word_id").alias("i"), F.col(word).alias("w"))))
    rows = items.groupBy("sentence_id").agg(packed.alias("r")).withColumn("ws", F.transform("r", lambda x: F.coalesce(x.w, F.lit(""))))
    rows = rows.select("sentence_id", "ws", "r", word_spans(F.col("ws")).alias("spans"))
    words = rows.select("sentence_id", F.posexplode(F.arrays_zip("r", "spans")).alias("word_index", "x")).select("sentence_id", "word_index", "x.r.i", "x.spans.start", "x.spans.end").withColumnRenamed("i", "word_id")
    sums = word_sums(token_scores(rows, factory), words, unit, name)
    scores = words.select("sentence_id", "word_index", "word_id").join(sums, ["sentence_id", "word_index"]).select("sentence_id", "word_id", name)
    return joins.expand_items(df, scores)
