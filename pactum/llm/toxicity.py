"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Words and stems (beginnings of longer words) that tell labelled documents apart are mined
from the labelled rows in rounds: each round takes those that are far likelier in documents labelled toxic, and mostly found
there, among the documents that none taken before explains, so words that only go
along with others are not taken. Each mined word or stem, fixed lists of insults in four languages
and patterns of spelling and address are voters: a voter fires on a document or abstains;
one of them, which fires where no word is known, speaks for clean.

The label model looks at whether voters fire together, over all documents. Were voters
independent but for what they say of toxicity, the covariances would be the products of
one number for each voter. Those numbers are fitted, anchored by the covariance with the
given labels, which are one more voter on the rows that have them; what then remains of a
covariance is a correlation of its own, and correlated voters share their say. The numbers
and the voters' rates give the rates of each voter on toxic and on clean documents, and
those the chance that a document is toxic.

These chances, not the labels, train a logistic regression on hashed words and the
voters, on at most about ``sample_rows`` labelled rows, chosen by a hash. Its probability
is the score. Counts of words and covariances cover all rows; nothing of the training is
sent but the lexicon, the voters' numbers and the weights, which have fixed sizes.

Labels count only of rows outside the fold that is held out; a null id counts as an empty
text there, so it is held out. Of several labels of one id the more frequent one holds, 1
if equal; null labels are none. Rows that repeat an id are scored each, and equal texts
count once in the training. Null and empty texts are scored as texts without words. Texts
of any length are read whole. Without labels of both kinds every score is the share of
label 1, one half where there is none. Empty tables give empty results; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.lexical import term_runs
from pactum.llm.textbytes import slices
from pactum.plans.scratch import discard, small, written

#: Labelled rows that the classifier is trained on, about, at most.
SAMPLE_ROWS = 8_192

#: Words that are mined at most, rounds of mining, and what a word needs: documents labelled toxic, and standard errors above chance.
MOST_WORDS, ROUNDS, LEAST_DOCUMENTS, LEAST_ERRORS = 48, 4, 5, 3.0

#: Slots into which words and stems are hashed to tell which of them toxic rows hold.
SLOTS = 1 << 20

#: Words and stems that are looked at in a round.
CANDIDATES = 200

#: Lengths of the beginnings of words that are mined and hashed like words.
STEMS = (4, 5, 6, 7, 8)

#: Counts that a task gathers before it hands them on, and words of which it keeps what it worked out.
GATHERED, KNOWN_WORDS = 1 << 19, 1 << 18

#: Of words that are taken in one round no one is found together with another in more than this part of its documents.
TOGETHER = 0.8

#: Residual correlation from which two voters count as correlated, if it is also above three standard errors.
CORRELATED = 0.03

#: Hashed word features.
BUCKETS = 1 << 16

# Common insults, phrases and pronouns of the second person.
INSULTS = {
    "en": "idiot idiots moron morons imbecile stupid dumb fool fools loser losers trash garbage scum jerk clown freak pig worthless pathetic disgusting bastard asshole bitch",
    "es": "idiota idiotas imbécil estúpido estúpida tonto tonta basura asqueroso asquerosa patético inútil payaso cabrón gilipollas puta",
    "fr": "idiot idiote imbécile stupide crétin abruti ordure connard connasse salaud salope dégoûtant pathétique minable bouffon",
    "de": "idiot idioten trottel dummkopf dumm blöd abschaum arschloch versager widerlich erbärmlich wertlos hurensohn schlampe müll",
}
PHRASES = ("shut up", "get lost", "drop dead", "go to hell", "hate you", "kill yourself", "piece of shit", "ta gueule", "halt die fresse", "vete a la mierda")
ADDRESS = "you your yours yourself u ur tu tú te ti usted ustedes toi vous votre du dich dir dein deine ihr euch"

_LISTS = {lang: frozenset(words.split()) for lang, words in INSULTS.items()}
_LISTED = frozenset().union(*_LISTS.values())
_ADDRESS = frozenset(ADDRESS.split())
_UPPER, _LOWER, _SYMBOLS = bytes(range(65, 91)), bytes(range(97, 123)), b"*#@$%"
_MASKED, _STRETCHED = re.compile(rb"[A-Za-z][*#@$%]{2,}[A-Za-z]"), re.compile(r"([a-z])\1{3}")
#: A word of each phrase, by which texts without one are passed over.
_PHRASE_WORDS = frozenset(max(p.split(), key=len).encode() for p in PHRASES)

#: Patterns that need the text; the others need only its words.
SPELLINGS = ("phrase", "shouting", "exclaiming", "masked")
OTHERS = ("stretched", "list_en", "list_es", "list_fr", "list_de", "addressed", "nothing")


class Known(dict):
    """What is worked out for a word, once for the many texts that hold it; forgotten when there are many words."""

    def __init__(self, work, most: int = KNOWN_WORDS):
        self.work, self.most = work, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.work(word)
        return out


class Finder:
    """What words stand for, of which few stand for anything: ``work`` gives it for a word, once for many texts."""

    def __init__(self, work):
        self.work, self.seen, self.hits = work, set(), {}
        self.hit_words: set[bytes] = set()

    def __call__(self, words: set[bytes]) -> set:
        new = words - self.seen
        if len(self.seen) > 4 * KNOWN_WORDS:
            self.seen.clear()
        for w in new:
            if w not in self.hit_words and (out := self.work(w)):
                self.hits[w] = out
                self.hit_words.add(w)
        self.seen |= new
        return {x for w in words & self.hit_words for x in self.hits[w]}


def described(raw: bytes | None) -> tuple[set[bytes], int]:
    """The distinct words of a text, and a bit for each of SPELLINGS that it shows."""
    raw, words, said = raw or b"", set(), False
    for run in term_runs(raw):
        words.update(run)
        if not (said or _PHRASE_WORDS.isdisjoint(run)):
            joined = b" ".join(run)
            said = any(p.encode() in joined for p in PHRASES)
    upper, lower, symbols = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _LOWER, _SYMBOLS))
    shows = (said, upper >= 20 and upper > 0.3 * (upper + lower), b"!!!" in raw, symbols > 1 and _MASKED.search(raw))
    return words, sum(1 << i for i, x in enumerate(shows) if x)


def entries_of(word: bytes) -> list[str]:
    """A word, and its beginnings marked by a star."""
    w = word.decode("utf-8", "replace")
    return [w, *(w[:k] + "*" for k in STEMS if k < len(w))]


def among(entries: set[str]):
    """Gives, for a word, those of some words and stems that it holds."""
    begun = {e[:-1]: e for e in entries if e.endswith("*")}
    lengths = sorted({len(b) for b in begun})

    def of(word: bytes) -> list[str]:
        w = word.decode("utf-8", "replace")
        out = [begun[w[:k]] for k in lengths if k < len(w) and w[:k] in begun]
        if w in entries:
            out.append(w)
        return out

    return of


class Voters:
    """The voters that a mined lexicon of words and stems gives: its entries, then SPELLINGS, then OTHERS."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = {w: i for i, w in enumerate(lexicon)}
        self.names = [*lexicon, *SPELLINGS, *OTHERS]
        self.spelled = len(lexicon)
        self.others = self.spelled + len(SPELLINGS)
        self.stems = {e[:-1]: i for e, i in self.lexicon.items() if e.endswith("*")}
        self.lengths = sorted({len(e) for e in self.stems})
        # most words are told from all stems by their first letters
        self.least = self.lengths[0] if self.lengths else 0
        self.begun = {e[: self.least] for e in self.stems}

    def __len__(self) -> int:
        return len(self.names)

    def of(self, word: bytes) -> tuple[int, ...]:
        """The voters that fire on a word; the one for address needs another word beside it."""
        w = word.decode("utf-8", "replace")
        out = []
        if w[: self.least] in self.begun:
            out += [self.stems[w[:k]] for k in self.lengths if k < len(w) and w[:k] in self.stems]
        if w in self.lexicon:  # what is mined is its own voter, not one of a list's
            out.append(self.lexicon[w])
        elif w in _LISTED:
            out += [self.others + 1 + i for i, own in enumerate(_LISTS.values()) if w in own]
        # four equal letters leave three fewer distinct ones
        if len(w) - len(set(w)) >= 3 and _STRETCHED.search(w):
            out.append(self.others)
        if w in _ADDRESS:
            out.append(self.others + 5)
        return tuple(out)

    def fire(self, by_words: set[int], spellings: int) -> list[int]:
        """The numbers of the voters that fire; ``by_words`` are those of the words."""
        out = by_words | {self.spelled + i for i in range(len(SPELLINGS)) if spellings >> i & 1}
        some = any(v < self.spelled or self.others < v <= self.others + 4 for v in by_words)
        if not some:
            out.discard(self.others + 5)
            if not spellings & 1:
                out.add(self.others + 6)
        return sorted(out)


@dataclass(frozen=True)
class LabelModel:
    """Rates of the voters on toxic and on clean documents, and how much each one's say counts; the last voter is the given label."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    share: np.ndarray
    correlated: list[tuple[int, int, float]]

    @classmethod
    def fit(cls, n: int, together: np.ndarray, labelled: np.ndarray, prior: float) -> LabelModel:
        """From the number of documents, the counts [voter, voter] of voters that fire together, and the covariances of voters with the label."""
        rate = np.diag(together) / n
        cov = together / n - np.outer(rate, rate)
        k = len(rate)
        full = np.zeros((k + 1, k + 1))
        full[:k, :k], full[k, :k], full[:k, k], full[k, k] = cov, labelled, labelled, prior * (1 - prior)
        scale = np.sqrt(np.maximum(np.diag(full), 1e-12))
        corr = full / np.outer(scale, scale)
        rates = np.append(rate, prior)
        # the label is nearly always right, to begin with
        v = np.clip(corr[k].copy(), -0.95, 0.95)
        v[k] = 0.95
        free, sure = ~np.eye(k + 1, dtype=bool), max(CORRELATED, 3 / math.sqrt(n))
        # the label weighs as much as all others: it is what ties the numbers to toxicity
        weight = np.append(np.ones(k), k)
        for _ in range(5):
            for _ in range(50):
                for i in range(k + 1):
                    j = free[i]
                    v[i] = np.clip((weight[j] * corr[i, j] * v[j]).sum() / max(1e-9, (weight[j] * v[j] ** 2).sum()), -0.99, 0.99)
            left = corr - np.outer(v, v)
            free = (np.abs(left) < sure) & ~np.eye(k + 1, dtype=bool)
            free[k, :k] = free[:k, k] = True
        if v[k] < 0:
            v = -v
        d = v * scale
        least = 1 / (n + 2)
        toxic = np.clip(rates + d * math.sqrt((1 - prior) / prior), least, 1 - least)
        clean = np.clip(rates - d * math.sqrt(prior / (1 - prior)), least, 1 - least)
        tied = np.where(free | np.eye(k + 1, dtype=bool), 0.0, left)
        pairs = [(i, j, float(left[i, j])) for i in range(k) for j in range(i + 1, k) if tied[i, j]]
        # only voters that fire together more than they should say the same thing twice
        return cls(prior, toxic, clean, 1 / (1 + np.maximum(0.0, tied).sum(axis=1)), pairs)

    def chance(self, fired: list[int], label: int | None = None) -> float:
        """The chance that a document is toxic on which these voters fire; others abstain."""
        z = math.log(self.prior / (1 - self.prior)) + float((np.log(self.toxic[fired] / self.clean[fired]) * self.share[fired]).sum())
        if label is not None:
            z += math.log(self.toxic[-1] / self.clean[-1] if label else (1 - self.toxic[-1]) / (1 - self.clean[-1]))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


# --- features and the classifier -----------------------------------------------------------------------------


def buckets_of(word: bytes) -> list[int]:
    """The buckets of a word and of its stems."""
    if word.isascii():
        starts = [word[:k] for k in STEMS if k < len(word)]
    else:
        w = word.decode("utf-8", "replace")
        starts = [w[:k].encode() for k in STEMS if k < len(w)]
    crc = zlib.crc32
    return [crc(word) & (BUCKETS - 1), *(crc(b"*", crc(x)) & (BUCKETS - 1) for x in starts)]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ ((t & 1) * np.uint32(0xEDB88320))
    return t


_CRC, _ALL_ONES = _crc_table(), np.uint32(0xFFFFFFFF)

#: Bytes up to which words are taken together.
SHORT_WORD = 64


def bucket_rows(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """UTF-8 words of at most SHORT_WORD bytes, longest first, and ``buckets_of`` each in a column: the word's and those of its stems, -1 where there is none."""
    words = sorted(words, key=len, reverse=True)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
    out = np.full((1 + len(STEMS), len(words)), -1, np.int32)
    row_of = np.full(SHORT_WORD + 1, -1)
    row_of[list(STEMS)] = range(1, 1 + len(STEMS))
    crc, chars = np.full(len(words), _ALL_ONES), np.zeros(len(words), np.int64)
    for i in range(int(sizes.max(initial=0))):
        m = int(np.searchsorted(-sizes, -i))  # longer words come first
        byte = data[first[:m] + i]
        begins = (byte & 0xC0) != 0x80
        row = row_of[chars[:m]]
        at = np.flatnonzero(begins & (row >= 0))  # a stem ends here and the word goes on
        c = crc[at]
        out[row[at], at] = (_CRC[(c ^ ord("*")) & 0xFF] ^ (c >> 8) ^ _ALL_ONES) & (BUCKETS - 1)
        chars[:m] += begins
        crc[:m] = _CRC[(crc[:m] ^ byte) & 0xFF] ^ (crc[:m] >> 8)
    out[0] = (crc ^ _ALL_ONES) & (BUCKETS - 1)
    return words, out


def train(rows: list[tuple[int, np.ndarray, list[int]]], chance: np.ndarray, voters: int, steps: int = 120, rate: float = 0.5, keep: float = 1e-4) -> np.ndarray:
    """Weights of the buckets, the voters and a constant: logistic loss against chances, by full gradients with a step for each weight.

    ``rows`` are (words, buckets, voters that fire); buckets weigh the less the more words there are.
    """
    size = BUCKETS + voters + 1
    index = [np.concatenate([b, np.array([*(BUCKETS + v for v in f), size - 1], np.int32)]) for _, b, f in rows]
    value = np.concatenate([np.concatenate([np.full(len(b), max(1, n) ** -0.5), np.ones(len(f) + 1)]) for n, b, f in rows])
    sizes = np.array([len(x) for x in index])
    index, first = np.concatenate(index), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    w, seen = np.zeros(size), np.zeros(size)
    for _ in range(steps):
        z = np.add.reduceat(w[index] * value, first)
        off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - chance) / len(rows)
        g = np.bincount(index, np.repeat(off, sizes) * value, size) + keep * w
        seen += g * g
        w -= rate * g / np.sqrt(seen + 1e-12)
    return w


class Scorer:
    """The probability of texts under trained weights; what a word adds is worked out once."""

    def __init__(self, voters: Voters, weights: np.ndarray):
        self.voters, self.weights = voters, weights.tolist()
        self.padded = np.append(weights[:BUCKETS], 0.0)  # bucket -1 adds nothing
        self.hits: dict[bytes, tuple[int, ...]] = {}
        self.hit_words: set[bytes] = set()
        self.adds = Known(self._word, 2 * KNOWN_WORDS)

    def _word(self, word: bytes) -> float:
        self._fires(word)
        return sum([self.weights[b] for b in buckets_of(word)])

    def _fires(self, word: bytes) -> None:
        if (fired := self.voters.of(word)) and word not in self.hit_words:
            self.hits[word] = fired
            self.hit_words.add(word)

    def learn(self, texts: list[set[bytes]]) -> None:
        """Work out what the new words of some texts add, short ones all at once."""
        if len(self.adds) >= self.adds.most:
            self.adds.clear()
        new = [w for w in set().union(*texts).difference(self.adds) if len(w) <= SHORT_WORD]
        try:
            b" ".join(new).decode()
        except UnicodeDecodeError:
            return  # one by one, when they are asked for
        new, rows = bucket_rows(new)
        sums = np.zeros(len(new))
        for row in rows:  # one after the other, so that the words beside it don't change a word's sum
            sums += self.padded[row]
        self.adds.update(zip(new, sums.tolist(), strict=True))
        for w in new:
            self._fires(w)

    def __call__(self, words: set[bytes], spellings: int) -> float:
        z = math.fsum(map(self.adds.__getitem__, words)) * max(1, len(words)) ** -0.5
        fired = self.voters.fire({v for w in words & self.hit_words for v in self.hits[w]}, spellings)
        z += self.weights[-1] + math.fsum(self.weights[BUCKETS + v] for v in fired)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


# --- Spark jobs ----------------------------------------------------------------------------------------------


def _raw(batch):
    import pyarrow as pa

    return batch.column("text").cast(pa.large_binary()).to_pylist()


def _described_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in (part for whole in batches for part in slices(whole)):
        found = [described(x) for x in _raw(batch)]
        words = pa.array([sorted(w) for w, _ in found], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), batch.column("toxic"), words, pa.array([s for _, s in found], pa.int32())], names=["id", "h", "toxic", "words", "spellings"])


def _entry_sets(batches: Iterator, some: set[str]) -> Iterator:
    """The words and stems of each row that are among some."""
    find = Finder(among(some))
    for batch in batches:
        for words in batch.column("words").to_pylist():
            yield find(set(words))


def _slot(entry: str) -> int:
    return zlib.crc32(entry.encode()) & (SLOTS - 1)


def _counts(explained: list[str], newly: list[str], slots: np.ndarray | None = None):
    """(entry, a, b): rows labelled toxic and not that hold each word or stem; entry null counts rows.

    Entries count whose slot is marked, if slots are given. Of all rows; or, if there is something ``newly`` taken, of the rows that hold something of
    it and nothing of what was ``explained`` before.
    """

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def handed_on():
            entries = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *(pa.array([held[y][w] for w in entries], pa.int64()) for y in (1, 0))], names=["entry", "a", "b"])
            held[0].clear(), held[1].clear()
            return out

        held, before, now = (Counter(), Counter()), set(explained), set(newly)
        wanted = (lambda w: entries_of(w)) if slots is None else (lambda w: [e for e in entries_of(w) if slots[_slot(e)]])
        known, some_of = Known(wanted), Finder(among(before | now))
        for batch in batches:
            for words, y in zip(batch.column("words").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if now:
                    some = some_of(set(words))
                    if some.isdisjoint(now) or not some.isdisjoint(before):
                        continue
                held[y].update(set().union(*(known[w] for w in words)))
                held[y][None] += 1
                if len(held[0]) + len(held[1]) > GATHERED:
                    yield handed_on()
        yield handed_on()

    return rows


def _pairs(explained: list[str], of: list[str]):
    """(one, other, n): rows that hold both, of the entries ``of``, and nothing that is explained."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        before, n = set(explained), Counter()
        for found in _entry_sets(batches, before | set(of)):
            if found.isdisjoint(before):
                n.update(permutations(sorted(found), 2))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in n], pa.string()) for i in (0, 1)] + [pa.array(n.values(), pa.int64())], names=["one", "other", "n"])

    return rows


def _together(voters: Voters):
    """Counts of voters that fire together, one row for each pair and task; (-1, -1) counts documents."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, counts, find = 0, np.zeros((len(voters), len(voters)), np.int64), Finder(voters.of)
        for batch in (part for whole in batches for part in slices(whole)):
            fired = np.zeros((batch.num_rows, len(voters)), np.float32)
            for i, x in enumerate(_raw(batch)):
                words, s = described(x)
                fired[i, voters.fire(find(words), s)] = 1
            n += len(fired)
            counts += np.rint(fired.T @ fired).astype(np.int64)
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(counts[i, j], n), pa.int64())], names=["i", "j", "n"])

    return rows


def _with_label(voters: Voters):
    """How often each voter fires on labelled rows, and on those labelled toxic, one row for each voter and task."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, toxic, find = np.zeros(len(voters), np.int64), np.zeros(len(voters), np.int64), Finder(voters.of)
        for batch in batches:
            for words, s, y in zip(*(batch.column(c).to_pylist() for c in ("words", "spellings", "toxic")), strict=True):
                fired = voters.fire(find(set(words)), s)
                n[fired] += 1
                toxic[fired] += y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(voters)), pa.int32()), pa.array(n), pa.array(toxic)], names=["voter", "n", "toxic"])

    return rows


def _fit(voters: Voters, model: LabelModel):
    def rows(table):
        import pyarrow as pa

        data, chance, find, buckets = [], [], Finder(voters.of), Known(buckets_of)
        for words, s, y in zip(*(table.column(c).to_pylist() for c in ("words", "spellings", "toxic")), strict=True):
            fired = voters.fire(find(set(words)), s)
            data.append((len(words), np.fromiter((b for w in words for b in buckets[w]), np.int32), fired))
            chance.append(model.chance(fired, y))
        weights = train(data, np.array(chance), len(voters))
        return pa.Table.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    return rows


def _scored(voters: Voters, weights: np.ndarray):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        probability = Scorer(voters, weights)
        for batch in (part for whole in batches for part in slices(whole)):
            found = [described(x) for x in _raw(batch)]
            probability.learn([words for words, _ in found])
            score = [probability(*f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows


def held_out(doc_id, folds: int = 5):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def mined(labelled: DataFrame, most: int = MOST_WORDS) -> list[str]:
    """Words and stems of (toxic, words) rows that set the toxic ones apart, in the order in which they were taken."""
    out: list[str] = []
    taken: list[str] = []
    schema = "entry string, a long, b long"
    # the toxic rows tell which entries can matter; of the others only those are counted, and what shares a slot with them
    often = labelled.filter("toxic = 1").mapInArrow(_counts([], []), schema).groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = written(often.filter((F.col("a") >= LEAST_DOCUMENTS) | F.col("entry").isNull()), "entries")
    slots = np.zeros(SLOTS, bool)
    marked = counts.filter("entry is not null").select(F.crc32(F.col("entry").cast("binary")).bitwiseAND(SLOTS - 1).cast("int").alias("slot")).distinct()
    slots[[r["slot"] for r in marked.collect()]] = True  # at most SLOTS numbers
    for _ in range(ROUNDS):
        # all rows are counted once; from then on the rows that were newly explained are taken off
        if taken:
            new = labelled.mapInArrow(_counts(out[: len(out) - len(taken)], taken, slots), schema).select("entry", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
        else:
            new = labelled.filter("toxic = 0").mapInArrow(_counts([], [], slots), schema)
        sums = counts.unionByName(new).groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        # counts only fall, so what is too rare now stays so
        left = written(sums.filter((F.col("a") >= LEAST_DOCUMENTS) | F.col("entry").isNull()), "entries")
        discard(counts)
        counts = left
        n = counts.filter("entry is null").first()
        if n is None:
            break
        a, b, n1, n0 = F.col("a"), F.col("b"), n["a"], n["b"]
        odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
        error = F.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
        apart = counts.filter("entry is not null").filter((a > b) & (odds / error >= LEAST_ERRORS))
        # of equal ones whole words, then longer stems, come first
        best = apart.orderBy((a - b).desc(), F.col("entry").endswith("*"), F.length("entry").desc(), "entry").limit(CANDIDATES).collect()
        # lesser ones may follow from these; they wait for the next round, which leaves out what these explain
        found = {r["entry"]: r["a"] for r in best if 2 * (r["a"] - r["b"]) >= best[0]["a"] - best[0]["b"]}
        if not found:
            break
        pairs = labelled.filter("toxic = 1").mapInArrow(_pairs(out, list(found)), "one string, other string, n long").groupBy("one", "other").agg(F.sum("n").alias("n"))
        along = {(r["one"], r["other"]): r["n"] for r in pairs.collect()}  # at most a number for each two candidates
        taken = []
        for w in found:
            if len(out) + len(taken) < most and all(along.get((w, u), 0) <= TOGETHER * found[w] for u in taken):
                taken.append(w)
        out += taken
        if len(out) >= most:
            break
    discard(counts)
    return out


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Written (id, toxic, words, spellings) of the rows that may be learned from, equal texts once."""
    one = labels.filter("toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    one = written(one.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_labelled"), "toxic"), "labels")
    texts = docs.select("doc_id", "text").join(small(one), F.col("doc_id") == F.col("_labelled"))
    rows = texts.select(F.monotonically_increasing_id().alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.col("toxic").cast("int").alias("toxic"), "text")
    found = written(rows.mapInArrow(_described_rows, "id long, h long, toxic int, words array<binary>, spellings int"), "described")
    first = written(found.groupBy("h").agg(F.min("id").alias("_first")).select("_first"), "first")
    return written(found.join(small(first), F.col("id") == F.col("_first"), "left_semi").drop("h"), "labelled")


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text); ``labels`` is (doc_id, toxic)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    learned = labelled_rows(texts, labels)
    n = learned.agg(F.count("*").alias("all"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if n["toxic"] in (0, n["all"]):
        share = n["toxic"] / n["all"] if n["all"] else 0.5
        return asked.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    voters, prior = Voters(mined(learned)), n["toxic"] / n["all"]
    # numbers for each pair of voters, however many the documents
    together = np.zeros((len(voters), len(voters)))
    documents = 0
    for r in texts.select("text").mapInArrow(_together(voters), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            documents = r["n"]
        else:
            together[r["i"], r["j"]] = r["n"]
    with_label = np.zeros(len(voters))
    for r in learned.mapInArrow(_with_label(voters), "voter int, n long, toxic long").groupBy("voter").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect():
        with_label[r["voter"]] = r["toxic"] / n["all"] - r["n"] / n["all"] * prior
    model = LabelModel.fit(documents, together, with_label, prior)
    part = F.pmod(F.xxhash64(F.col("id"), F.lit(12)), F.lit(1 << 20)) < F.lit(min(1.0, sample_rows / n["all"]) * (1 << 20))
    fitted = learned.filter(part).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_fit(voters, model), "weights binary").first()
    if fitted is None:
        raise ValueError("the sample holds no row; raise sample_rows")
    weights = np.frombuffer(bytes(fitted["weights"]), np.float64)
    discard(learned)
    return asked.mapInArrow(_scored(voters, weights), "doc_id long, held_out boolean, score double, predicted int")
