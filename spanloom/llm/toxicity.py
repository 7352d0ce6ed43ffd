"""Abusive, hateful or sexual content: a linear-chain conditional random field over the words of each sentence."""

from __future__ import annotations

import io
import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.toxic_seeds import ADJECTIVES, INSULTS, SEXUAL, THREATS, VERMIN, Seed, seed_sentences
from spanloom.session import spread
from spanloom.sources.files import locate

#: Most labelled documents the tagger is fitted on, taken in the order of a hash of their key.
LABELLED_DOCUMENTS = 1_500
#: Buckets of the hashed features.
BUCKETS = 1 << 18
#: A document with a word at least this likely to be part of a passage is found.
THRESHOLD = 0.5
#: A sentence of a document labelled harmful that is less likely a passage than this is not taken for the one that was meant.
LIKELY = 0.1
#: Of the quadratic penalty on weights.
PENALTY = 0.2
#: How often a sentence of a document labelled harmless counts: harmful ones are far more frequent among labelled documents than among all.
HARMLESS_WEIGHT = 3.0
#: Documents tagged side by side, and words remembered by a worker.
SIDE_BY_SIDE, REMEMBERED = 2_048, 300_000

# Letters and digits of scripts that write blanks between words; vowel signs belong to them.
LETTERS = (
    r"0-9A-Za-zªµºÀ-ÖØ-öø-ͽͿ-؋؍-ؚ؜ؠ-٩ٮ-ۓە-ॣ०-෿"
    r"Ⴀ-᛿Ḁ-῿Ꙁ-꛿가-힯０-９Ａ-Ｚａ-ｚ\U0001d400-\U0001d7ff"
)
HIDDEN = "​-‍⁠﻿­"
#: Letters set apart; one sign of a script without blanks; a word; what ends a sentence; quotation marks.
TOKEN = re.compile(
    rf"(?<![{LETTERS}])[A-Za-zÀ-ɏͰ-ӿ](?:[  ._-][A-Za-zÀ-ɏͰ-ӿ]){{3,}}(?![{LETTERS}])"
    r"|[぀-ゟ㐀-鿿]|[゠-ヿ]+|[຀-໿က-႟ក-៿]|[฀-๿][ัิ-ฺ็-๎]*"
    rf"|[$@]?[{LETTERS}](?:[{LETTERS}$@*#_{HIDDEN}]|['’-](?=[{LETTERS}]))*"
    r"|[!?。！？؟।…]+|\.+(?=[\s\"”»)]|$)|\n\s*\n|[\"“”„«»「」]"
)
ENDERS = frozenset("!?。！？؟।….\n")
APART = re.compile(r"[  ._-]")
INVISIBLE = re.compile(f"[{HIDDEN}]")
# Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKES = str.maketrans("асеорхуіјѕԁһкмтвнгпαορνικτυ", "aceopxyijsdhkmtbhrnaopviktu")
LEET = str.maketrans("013457$@!", "oieastsai")
LATIN = re.compile(r"[a-zß-ɏ]")
OTHER = re.compile(r"[Ͱ-ӿ]")
LONG_RUN = re.compile(r"(.)\1{2,}")
INNER = re.compile(r"(?<=[^\W\d_])[_.*#-](?=[^\W\d_])")
MASK = re.compile(r"[*#]+")
SIGNS = re.compile(r"[\d$@!]")
#: Letters and numbers that are no disguise: CD20, 5mg, 2024a.
CODES = re.compile(r"[^\W\d_]+-?\d+|\d+[^\W\d_]+|.*\d{2,}.*")


def plain(word: str) -> str:
    """A word as it was before someone disguised it: compatibility forms, invisible signs, look-alike letters, digits
    for letters, stretched letters and separators undone. ``*`` for letters stays."""
    word = INVISIBLE.sub("", unicodedata.normalize("NFKC", word)).lower().replace("’", "'")
    if LATIN.search(word) and OTHER.search(word):
        word = word.translate(LOOKALIKES)
    if any(c.isalpha() for c in word) and SIGNS.search(word) and (not CODES.fullmatch(word) or word == "1d10t"):
        word = word.translate(LEET)
    word = LONG_RUN.sub(r"\1", word)
    if "*" not in word and "#" not in word:
        word = INNER.sub("", word)
    return word


LEXICON: dict[str, int] = {}
for _number, _words in enumerate((sum(INSULTS.values(), []), ADJECTIVES, VERMIN, SEXUAL, THREATS), 1):
    for _word in _words:
        if len(plain(_word)) > 1 or not _word.isascii():  # not the one letter that xxx is without its stretching
            LEXICON.setdefault(plain(_word), _number)
MASKED = 6
# Words that tell who speaks of whom: to someone, of oneself, as a report, of many.
CUES = [
    "you your you're yours u ur yourself du dich dein deine dir tu te toi ta ton ты тебя тебе твой 你 お前 あなた أنت يا είσαι σε तुम तू तेरा มึง แก คุณ eres".split(),
    "i me my myself i'm ich mich je mon ma yo mi я мне мой 我 私 أنا ฉัน मैं".split(),
    """asked word words term terms reported report called documented recorded coded described remarks comments police visitor visitors staff nurses diagnosis study studied
    participants patients cohort examined examination swabs wort mot palabra слово 词 語 語 言葉 كلمة λέξη शब्द คำว่า""".split(),
    "all every they them those these alle tous todos все 都 みんな die los les".split(),
]
CUE = {plain(word): 1 << at for at, words in enumerate(CUES) for word in words}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


#: Per word: its hash, those of its first four and last three letters, class in the lexicon, cues, shape, whether it ends a sentence.
WORD_FIELDS = 7


def describe(word: str) -> tuple[int, ...]:
    if word[0] in ENDERS:
        return _hash(word[:1]), _hash("p"), _hash("s"), 0, 0, 3, 1
    if " " in word or " " in word or word.count(".") > 2:
        word = APART.sub("", word)
    simple = plain(word)
    if MASK.search(simple) and any(c.isalpha() for c in simple):
        fits = [w for w in LEXICON if len(w) == len(simple) and all(a in ("*", "#", b) for a, b in zip(simple, w))]
        if len(fits) != 1:
            return _hash(MASK.sub("*", simple)), _hash("*" + simple[:1]), _hash("*"), MASKED, CUE.get(simple, 0), 3, 0
        simple = fits[0]
    return _described(word, simple, any(c.isdigit() for c in simple))


def _described(word: str, simple: str, digits: bool) -> tuple[int, ...]:
    kind = LEXICON.get(simple, 0)
    if not kind and simple.endswith("s"):
        kind = LEXICON.get(simple[:-1], 0)
    shape = 1 if digits else 2 if word[:1].isupper() else 0
    if digits:
        simple = re.sub(r"\d+", "0", simple)
    return _hash(simple), _hash("p" + simple[:4]), _hash("s" + simple[-3:]), kind, CUE.get(simple, 0), shape, 0


class Words(dict):
    """Numbers of words, described when first met; ``rows`` are the descriptions. A worker's memory, up to a bound."""

    def __init__(self) -> None:
        super().__init__()
        self.described: list[tuple[int, ...]] = []
        self.table = np.zeros((0, WORD_FIELDS), np.uint64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.described)
        self.described.append(describe(word))
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.described) > len(self.table):
            self.table = np.concatenate([self.table, np.array(self.described[len(self.table) :], np.uint64)])
        return found

    def forget(self) -> bool:
        """Let go of all words if they are too many; the numbers given so far mean nothing then."""
        if len(self) <= REMEMBERED:
            return False
        self.clear()
        self.described, self.table = [], np.zeros((0, WORD_FIELDS), np.uint64)
        return True


def _mix(values: np.ndarray, seed: int) -> np.ndarray:
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x >> np.uint64(32)


def _buckets(groups: list[np.ndarray], first: int) -> np.ndarray:
    return np.stack([(_mix(g, first + i) & np.uint64(BUCKETS - 1)).astype(np.int32) for i, g in enumerate(groups)], axis=1)


def own_features(rows: np.ndarray) -> np.ndarray:
    """Bucket numbers of what a word is by itself."""
    word, prefix, suffix, kind, cue, shape = (rows[:, i] for i in range(6))
    return _buckets([word, prefix, suffix, kind, cue, shape * np.uint64(8) + kind], 1)


def near_features(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bucket numbers of what stands beside a word and in its sentence. ``rows`` describe the words of all sentences one behind the other."""
    n = len(rows)
    word, kind, cue = rows[:, 0], rows[:, 3], rows[:, 4]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)

    def beside(values: np.ndarray, step: int) -> np.ndarray:
        moved = np.full(n, 7, np.uint64)
        if step < 0 and n > -step:
            same = owner[-step:] == owner[:step]
            moved[-step:][same] = values[:step][same]
        elif step > 0 and n > step:
            same = owner[:-step] == owner[step:]
            moved[:-step][same] = values[step:][same]
        return moved

    of_sentence = lambda bits: np.bitwise_or.reduceat(bits, starts)[owner]
    kinds, cues = of_sentence(np.uint64(1) << kind), of_sentence(cue)
    before, after = beside(word, -1), beside(word, 1)
    three = np.uint64(3)
    groups = [
        before, after, beside(word, -2), beside(word, 2), word * three + before, word * three + after,
        kind * np.uint64(8) + beside(kind, -1), kind * np.uint64(8) + beside(kind, 1), kind * np.uint64(256) + cues,
        kind * np.uint64(64) + beside(cue, -1), kind * np.uint64(1 << 20) + kinds * np.uint64(256) + cues,
    ]
    return _buckets(groups, 21)


@dataclass
class Chain:
    """Weights of the features for being in a passage, those of the four transitions between out (0) and in (1) and of the
    two starts, and the least sum that a sentence's words have to reach by themselves (:meth:`Tagger.tag`)."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    least: float = 0.0

    def marginals(self, unary: np.ndarray, lengths: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By forward and backward sums: each word's probability to be in a passage, the expected transitions and
        starts, each sentence counted by its ``weight``. Sentences of about the same length are summed side by side,
        forward sums brought to one at each word so that none can overflow."""
        result = np.zeros(len(unary))
        pairs, starts = np.zeros((2, 2)), np.zeros(2)
        weight = np.ones(len(lengths)) if weight is None else weight
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        move, first = np.exp(self.moves), np.exp(self.start)
        odds = np.exp(np.clip(unary, -40, 40))
        at = 0
        while at < len(order):
            shortest = int(lengths[order[at]])
            stop = int(np.searchsorted(lengths[order], shortest + shortest // 4 + 4, "right"))
            own = order[at : min(stop, at + 8_192)]
            at += len(own)
            size = int(lengths[own].max())
            place = begins[own][None, :] + np.arange(size)[:, None]
            there = np.arange(size)[:, None] < lengths[own][None, :]
            e = np.where(there, odds[np.minimum(place, len(unary) - 1)], 1.0)
            out, inn, scale = np.empty((size, len(own))), np.empty((size, len(own))), np.ones((size, len(own)))
            a, b = np.full(len(own), first[0]), first[1] * e[0]
            scale[0] = a + b
            out[0], inn[0] = a / scale[0], b / scale[0]
            for t in range(1, size):
                a = out[t - 1] * move[0, 0] + inn[t - 1] * move[1, 0]
                b = (out[t - 1] * move[0, 1] + inn[t - 1] * move[1, 1]) * e[t]
                if t >= shortest:
                    a, b = np.where(there[t], a, out[t - 1]), np.where(there[t], b, inn[t - 1])
                scale[t] = a + b
                out[t], inn[t] = a / scale[t], b / scale[t]
            back_out, back_in = np.ones(len(own)), np.ones(len(own))
            inside = np.empty((size, len(own)))
            inside[-1] = inn[-1]
            w = weight[own]
            for t in range(size - 2, -1, -1):
                ahead_out, ahead_in = back_out / scale[t + 1], e[t + 1] * back_in / scale[t + 1]
                live = there[t + 1] * w
                pairs[0] += (out[t] * move[0, 0] * ahead_out) @ live, (out[t] * move[0, 1] * ahead_in) @ live
                pairs[1] += (inn[t] * move[1, 0] * ahead_out) @ live, (inn[t] * move[1, 1] * ahead_in) @ live
                a, b = move[0, 0] * ahead_out + move[0, 1] * ahead_in, move[1, 0] * ahead_out + move[1, 1] * ahead_in
                if t + 1 >= shortest:
                    a, b = np.where(there[t + 1], a, 1.0), np.where(there[t + 1], b, 1.0)
                back_out, back_in = a, b
                inside[t] = inn[t] * back_in
            result[place[there]] = inside[there]
            starts += [float((1 - inside[0]) @ w), float(inside[0] @ w)]
        return result, pairs, starts

    def unary(self, ids: np.ndarray) -> np.ndarray:
        return self.weights[ids].sum(1, dtype=np.float64)

    def save(self, path: str) -> None:
        """Write the fitted chain to a file of any file system of :mod:`spanloom.sources.files`."""
        data = io.BytesIO()
        np.savez_compressed(data, weights=self.weights, moves=self.moves, start=self.start, least=self.least)
        system, inner = locate(path)
        with system.open_output_stream(inner) as out:
            out.write(data.getvalue())

    @classmethod
    def load(cls, path: str) -> Chain:
        system, inner = locate(path)
        with system.open_input_file(inner) as source:
            found = np.load(io.BytesIO(source.read()))
        return cls(found["weights"], found["moves"], found["start"], float(found["least"]))


@dataclass
class Sample:
    """Sentences to fit on: descriptions of their words one behind the other, sentence lengths, labels and weights."""

    rows: np.ndarray
    lengths: np.ndarray
    gold: np.ndarray
    weight: np.ndarray

    def ids(self) -> np.ndarray:
        return np.concatenate([own_features(self.rows), near_features(self.rows, self.lengths)], axis=1)


def _fit(sample: Sample, ids: np.ndarray, rounds: int, begun: Chain | None = None) -> Chain:
    """Maximum likelihood with AdaGrad steps over all sentences and a quadratic penalty, from ``begun`` on if there is one.

    Transitions and starts are fitted like the features, by the difference of what the labels have and what is expected."""
    chain = Chain(begun.weights.copy(), begun.moves.copy(), begun.start.copy()) if begun else Chain(np.zeros(BUCKETS, np.float32), np.zeros((2, 2)), np.zeros(2))
    lengths, gold = sample.lengths, sample.gold
    owner = np.repeat(np.arange(len(lengths)), lengths)
    weight = sample.weight[owner]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    follows = np.ones(len(gold), bool)
    follows[first] = False
    at = np.flatnonzero(follows)
    seen, began = np.zeros((2, 2)), np.zeros(2)
    np.add.at(seen, (gold[at - 1].astype(int), gold[at].astype(int)), weight[at])
    np.add.at(began, gold[first].astype(int), sample.weight)
    squares, move_squares, start_squares = np.full(BUCKETS, 1.0, np.float32), np.full((2, 2), 1.0), np.full(2, 1.0)
    flat = ids.ravel()
    for _ in range(rounds):
        inside, pairs, starts = chain.marginals(chain.unary(ids), lengths, sample.weight)
        error = (gold - inside) * weight
        gradient = np.bincount(flat, weights=np.repeat(error, ids.shape[1]), minlength=BUCKETS).astype(np.float32) - PENALTY * chain.weights
        squares += gradient * gradient
        chain.weights += 0.35 * gradient / np.sqrt(squares)
        for values, total, step in ((chain.moves, move_squares, seen - pairs), (chain.start, start_squares, began - starts)):
            total += step * step
            values += 0.2 * step / np.sqrt(total)
    return chain


def _disguised(word: str, rng: random.Random) -> str:
    if len(word) < 4 or not word.isascii():
        return word
    how, at = rng.randrange(5), rng.randrange(1, len(word) - 1)
    if how == 0:
        return word[0] + "*" * (len(word) - 2) + word[-1]
    if how == 1:
        return word[: at + 1] + word[at] * 4 + word[at + 1 :]
    if how == 2:
        return " ".join(word)
    if how == 3:
        return word[:at] + "-" + word[at:]
    return word[:1] + "***"


def disguised_seeds(seeds: list[Seed], seed: int = 3) -> list[Seed]:
    """Passages with some of their telling words disguised, and some in capitals."""
    rng = random.Random(seed)
    found = []
    for sentence, begin, end in seeds:
        if end > begin and rng.random() < 0.5:
            own = " ".join(_disguised(w, rng) if LEXICON.get(plain(w.strip(".,!?"))) and rng.random() < 0.6 else w for w in sentence[begin:end].split(" "))
            found.append((sentence[:begin] + own + sentence[end:], begin, begin + len(own)))
            if rng.random() < 0.3:
                found.append((sentence.upper(), begin, end) if len(sentence.upper()) == len(sentence) else (sentence, begin, end))
    return found


class Tagger:
    """The fitted chain with the words it needs."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        self.words = Words()
        self.own = np.zeros(0)

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts one behind the other, words per text, sentence lengths, the text of each sentence."""
        if self.words.forget():
            self.own = np.zeros(0)
        each = [TOKEN.findall(text) if text else [] for text in texts]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        numbers = self.words.numbers([word for words in each for word in words])
        n = len(numbers)
        if not n:
            return numbers, sizes, np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = self.words.table[numbers, 6].astype(bool)
        text_of = np.repeat(np.arange(len(each)), sizes)
        begins = np.ones(n, bool)
        begins[1:] = (ends[:-1] & ~ends[1:]) | (text_of[1:] != text_of[:-1])
        starts = np.flatnonzero(begins)
        return numbers, sizes, np.diff(np.append(starts, n)), text_of[starts]

    def by_itself(self, numbers: np.ndarray) -> np.ndarray:
        """What each word adds to its sentence's sum: its own features' weights, if together above 0."""
        if len(self.own) < len(self.words.table):
            more = self.chain.unary(own_features(self.words.table[len(self.own) :]))
            self.own = np.concatenate([self.own, np.maximum(more, 0.0)])
        return self.own[numbers]

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each word to be in a passage, and words per text.

        In two steps. A sentence whose words' own sums stay below ``least``, half of the smallest one that a passage fitted
        on has, has no passage; on all other sentences the chain is run."""
        numbers, sizes, lengths, _ = self.sentences(texts)
        inside = np.zeros(len(numbers))
        if len(numbers):
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            kept = np.add.reduceat(self.by_itself(numbers), starts) >= self.chain.least
            mask = np.repeat(kept, lengths)
            if mask.any():
                rows, own = self.words.table[numbers[mask]], lengths[kept]
                unary = self.chain.unary(own_features(rows)) + self.chain.unary(near_features(rows, own))
                inside[mask] = self.chain.marginals(unary, own)[0]
        return inside, sizes

    def tag(self, texts: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """For each text its words' ``(begin, end, probability)``."""
        inside, sizes = self.probabilities(texts)
        stops = np.cumsum(sizes)
        return [
            [(*m.span(), float(p)) for m, p in zip(TOKEN.finditer(text or ""), inside[stop - size : stop])]
            for text, size, stop in zip(texts, sizes, stops)
        ]


def _seed_sample(tagger: Tagger, seeds: list[Seed]) -> Sample:
    """Seeds sentence by sentence, in which the words of a passage are labelled."""
    texts = [sentence for sentence, _, _ in seeds]
    numbers, sizes, lengths, _ = tagger.sentences(texts)
    gold = np.zeros(len(numbers))
    at = 0
    for (sentence, begin, end), size in zip(seeds, sizes):
        if end > begin:
            gold[at : at + size] = [begin <= m.start() and m.end() <= end for m in TOKEN.finditer(sentence)]
        at += size
    rows = tagger.words.table[numbers]
    harmful = np.add.reduceat(gold, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)) > 0
    return Sample(rows, lengths, gold, np.where(harmful, 1.0, 2.0))


@lru_cache(1)
def seed_chain() -> Chain:
    """The chain fitted on all seeds; the same in every process, so a process fits it once."""
    tagger = Tagger(Chain(np.zeros(BUCKETS, np.float32), np.zeros((2, 2)), np.zeros(2)))
    seeds = seed_sentences()
    sample = _seed_sample(tagger, seeds + disguised_seeds(seeds))
    ids = sample.ids()
    return _least(_fit(sample, ids, 40), sample)


def _least(chain: Chain, sample: Sample) -> Chain:
    """``chain`` with the least sum of the passages it was fitted on."""
    starts = np.concatenate([[0], np.cumsum(sample.lengths)[:-1]]).astype(np.int64)
    sums = np.add.reduceat(np.maximum(chain.unary(own_features(sample.rows)), 0.0), starts)
    harmful = (np.add.reduceat(sample.gold, starts) > 0) & (sample.weight > 0)
    chain.least = 0.5 * float(sums[harmful].min()) if harmful.any() else 0.0
    return chain


def fit_chain(labelled: list[tuple[str, bool]], rounds: int = 2) -> Chain:
    """Fit on the seed sentences, whose words are labelled, and on labelled documents.

    Raters label documents, and err. So the chain fitted so far tags the documents: in one labelled harmful the words
    with a probability of a half are passages, or if there are none the whole of the one sentence that is likeliest;
    sentences with no likely word count as harmless, and others not at all. In a document labelled harmless all
    sentences are, but one that is very likely a passage is left out. Then the chain is fitted on, ``rounds`` times.
    """
    chain = seed_chain()
    labelled = [(text, harmful) for text, harmful in labelled if text]
    if not labelled:
        return chain
    tagger = Tagger(chain)
    seeds = seed_sentences(repeats=4, background=1_000)
    base = _seed_sample(tagger, seeds + disguised_seeds(seeds))
    numbers, _, lengths, text_of = tagger.sentences([text for text, _ in labelled])
    harmful = np.array([h for _, h in labelled])[text_of]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    rows = tagger.words.table[numbers]
    both_rows, both_lengths = np.concatenate([base.rows, rows]), np.concatenate([base.lengths, lengths])
    ids = Sample(both_rows, both_lengths, np.zeros(0), np.zeros(0)).ids()
    own_ids = ids[len(base.rows) :]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for _ in range(rounds):
        inside = chain.marginals(chain.unary(own_ids), lengths)[0]
        best = np.maximum.reduceat(inside, starts)
        of_text = np.zeros(len(labelled))
        np.maximum.at(of_text, text_of, best)
        found = harmful & (best >= 0.5) & (best >= 0.8 * of_text[text_of])
        gold = ((inside >= 0.5) & found[owner]).astype(float)
        likeliest = harmful & (of_text[text_of] < 0.5) & (best == of_text[text_of]) & (best > LIKELY)
        gold[likeliest[owner]] = 1.0
        weight = np.where(harmful, np.where(found, 1.0, np.where(likeliest, 0.5, np.where(best < 0.1, 0.5, 0.0))), np.where(best > 0.9, 0.5 * HARMLESS_WEIGHT, HARMLESS_WEIGHT))
        sample = Sample(both_rows, both_lengths, np.concatenate([base.gold, gold]), np.concatenate([base.weight, weight]))
        chain = _least(_fit(sample, ids, 15, chain), sample)
    return chain


def fit_tagger(labelled: list[tuple[str, bool]]) -> Tagger:
    return Tagger(fit_chain(labelled))


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = LABELLED_DOCUMENTS) -> list[tuple[str, bool]]:
    """At most ``most`` documents with the majority of their raters' labels (null labels and ties left out)."""
    votes = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(
        F.sum(F.when(F.col("label") == "none", -1).otherwise(1)).alias("votes")
    )
    chosen = votes.where("votes <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # most rows of two numbers
    return sorted((row["text"], row["votes"] > 0) for row in texts.select("text", "votes").collect())


PASSAGES = "array<struct<begin_pos:int,end_pos:int,score:double>>"
PASSAGES_TYPE = pa.list_(pa.struct([("begin_pos", pa.int32()), ("end_pos", pa.int32()), ("score", pa.float64())]))


def passages_of(words: list[tuple[int, int, float]], threshold: float) -> list[dict]:
    """Runs of words at ``threshold`` or above, each with its largest probability."""
    found: list[dict] = []
    open_run = False
    for begin, end, p in words:
        if p >= threshold and open_run:
            found[-1] = {"begin_pos": found[-1]["begin_pos"], "end_pos": end, "score": max(found[-1]["score"], p)}
        elif p >= threshold:
            found.append({"begin_pos": begin, "end_pos": end, "score": p})
        open_run = p >= threshold
    return found


def score_documents(documents: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, chain: Chain | None = None) -> DataFrame:
    """``(doc_id, source, score, passages)`` of every row.

    ``chain`` is a fitted one (:meth:`Chain.load`); without it one is fitted on seeds and on at most ``LABELLED_DOCUMENTS``
    labelled documents. Its weights, a fixed megabyte, are broadcast, and whole texts are tagged in one narrow pass.
    ``score`` is the largest marginal probability of a word to be in a passage, ``passages`` the runs of words at
    ``threshold`` or above with their largest one. Null, empty and blank texts score 0 without passages; repeated rows
    are scored each; no labels at all leave the seeds; an empty table gives no rows; other columns do not take part.
    """
    spark = documents.sparkSession
    if chain is None:
        chain = fit_chain(labelled_sample(documents, labels) if labels is not None else [])
    shared = spark.sparkContext.broadcast((chain.weights, chain.moves, chain.start, chain.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Chain(*shared.value))
        for batch in batches:
            for begin in range(0, batch.num_rows, SIDE_BY_SIDE):
                part = batch.slice(begin, SIDE_BY_SIDE)
                texts = part.column(2).to_pylist()
                inside, sizes = tagger.probabilities(texts)
                stops = np.cumsum(sizes)
                scores, passages = np.zeros(len(texts)), []
                for at, (text, size, stop) in enumerate(zip(texts, sizes, stops)):
                    own = inside[stop - size : stop]
                    scores[at] = own.max() if size else 0.0
                    hit = scores[at] >= threshold
                    passages.append(passages_of([(*m.span(), float(p)) for m, p in zip(TOKEN.finditer(text), own)], threshold) if hit else [])
                columns = [part.column(0), part.column(1), pa.array(scores), pa.array(passages, PASSAGES_TYPE)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "score", "passages"])

    narrow = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text"))
    return spread(narrow).mapInArrow(run, f"doc_id bigint, source string, score double, passages {PASSAGES}")


def rates_by_source(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (null is one): documents, documents found, their rate, the mean score."""
    found = F.sum((F.col("score") >= threshold).cast("bigint"))
    return scored.groupBy("source").agg(
        F.count("*").alias("n_documents"), found.alias("n_found"), (found / F.count("*")).alias("rate"), F.avg("score").alias("mean_score")
    )
