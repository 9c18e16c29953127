"""Near-duplicate passages by compact windows.

Tokens are 5-word shingles.  A Cartesian tree over a text's token hashes gives its compact
windows: a smallest token and the widest range in which it is smallest, so that every
subsequence of the range that holds the token has the same min-hash.  Only ranges that can
hold RUN words are kept, about 2 n / RUN of n tokens.

A passage of similarity SIMILARITY holds RUN words verbatim: with b breaks, each of which
costs 9 shingles at least, its runs have 40 b + 4 words or more, so the longest of its
b + 1 runs has 22.  (Only where all shingles across a break come again inside runs could a
passage do with shorter ones.)  A run of RUN words lies whole in such a window of both
texts, so one hash function finds all passages, verbatim and near.

A common phrase can be the smallest token of many unrelated windows, so windows meet under
two keys, the RUN / 2 words from the token on, and as many words up to it: a run holds one
of the two, wherever the token lies in it.  Under the second only those meet that have not
met under the first.  Windows of one key are joined where the
intervals, laid over each other at the token, still hold a run (interval join):

* those whose words agree REACH words to both sides are one, the first of them;
* of up to HOT different ones all pairs go on to verification, as do all pairs of documents
  where these are no more than PAIRS for each window;
* of more, each is held against all that it isn't connected with: words compared from the
  token outwards give verbatim passages, and leave out whom no shingle follows within
  a gap's words of a common run too short to do alone, and who have too few shingles in common;
  what is left is verified on these words.  Pairs that connect what is linked go on to
  verification.

So no link is left out, but links inside what others connect are not listed.

Verification: exact runs of words, joined over short gaps, of SPAN words and a shingle
similarity of SIMILARITY at least, also with words that differ at its ends; of a chain of
runs that fails, its longest parts that pass.  The places of passages, those that overlap in one document as one, and the
links between them make classes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import near_dup, workspace
from strandline.llm.textkernel import _P, Words, grouped, mix, sliding_min, strings

SHINGLE = 5
SPAN = 50
SIMILARITY = 0.8
RUN = 22
FUNCTIONS = 1
MEMBERS = 64
FEW_RUNS = 16
HOT = 3
PAIRS = 4
BATCH_WINDOWS = 1 << 18
BLOCK = 4096

_SEEDS = mix(np.arange(101, 101 + FUNCTIONS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
#: key, hash of the words around, other key (32 bits; 0: none), place of the token, tokens of room on its left and right
_WINDOW = np.dtype([("key", "<i8"), ("around", "<i8"), ("other", "<i4"), ("at", "<i8"), ("left", "<i8"), ("right", "<i8")])
_ROOM = 5  # bits


def _gap(span: int, similarity: float = SIMILARITY) -> int:
    """Words that can stand between two runs of a passage, neither of which is a span of its own.

    Runs of n words with g words between them on one side have n - 8 shingles of n + g in
    common, and n is 2 (span - 1) at most.  A longer gap beside a longer run only makes that
    run's similarity less, so the run is a passage by itself.
    """
    n = 2 * (span - 1)
    return int((n - 2 * (SHINGLE - 1)) / similarity - n + 1e-9)


def _reach(span: int) -> int:
    """Words on each side of a token that hold a passage's shortest part that passes: two runs, each shorter than a span, and a gap."""
    return 2 * span + _gap(span) - 2


def compact_windows(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(smallest value, lo, hi) of the ranges [lo, hi) of at least that many tokens: the nodes
    of the Cartesian tree that are wide enough.

    Equal values share their range: all their places are in it, and only the gaps
    between them go on.
    """
    out, stack = [], [(0, len(h))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < least:
            continue
        part = h[lo:hi]
        v = part.min()
        out.append((int(v), lo, hi))
        at = lo
        for p in (np.flatnonzero(part == v) + lo).tolist():
            stack.append((at, p))
            at = p + 1
        stack.append((at, hi))
    return out


def window_tokens(h: np.ndarray, least: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, left, right): the smallest token of each compact window, and the tokens of it
    on the left, and on the right with itself, as far as they matter: least at most.

    A node of the Cartesian tree is wide enough where its token is the smallest of some
    ``least`` neighbours, and the neighbourhoods in which it is are next to each other; so
    the nodes of many texts come from one sliding minimum.  Of equal tokens the first in a
    neighbourhood counts.  inside: which neighbourhoods lie in one text.
    """
    place = np.arange(len(h), dtype=np.uint64)
    low = sliding_min((h >> np.uint64(32)) << np.uint64(32) | place, least)
    at = np.flatnonzero(inside[: len(low)])
    token = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(token):
        return token, token, token
    new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    token, first, last = token[new], at[new], at[np.append(new[1:], len(at)) - 1]
    return token, token - first, last + least - token


def _around(words: Words, begin: np.ndarray, end: np.ndarray, token: np.ndarray, reach: int) -> np.ndarray:
    """Hash of the words up to reach before and after each token, as far as its text goes, and of where the token is in them."""
    p = np.uint64(_P)
    powers, inverse = (np.append(np.uint64(1), np.multiply.accumulate(np.full(len(words), x, np.uint64))) for x in (p, np.uint64(pow(_P, -1, 1 << 64))))
    total = np.append(np.uint64(0), np.cumsum(words.hash * powers[:-1], dtype=np.uint64))
    a, b = np.maximum(begin, token - reach), np.minimum(end, token + reach)
    h = (total[b] - total[a]) * inverse[a]
    return mix(mix(h) + ((token - a) << 32 | b - a).astype(np.uint64)).view(np.int64)


def _keyed(words: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of the windows of a run of texts, with their keys; texts shorter than a span have none."""
    run = min(span, RUN)
    least, half = run - SHINGLE + 1, run // 2
    n = len(words)
    of = np.repeat(np.arange(len(words.of) - 1), np.diff(words.of))
    begin, end = words.of[:-1][of], words.of[1:][of]  # of the text of each word
    inside = (np.arange(n) + run <= end) & (end - begin >= span)
    docs, parts = [], []
    tokens = words.grams(SHINGLE)
    if len(tokens) < least:
        return np.empty(0, np.int64), np.empty(0, _WINDOW)
    again = np.append(0, np.cumsum(words.hash[1:] == words.hash[:-1]))
    for i in range(FUNCTIONS):
        token, left, right = window_tokens(tokens * _SEEDS[i], least, inside)
        inner = (token > begin[token]) & (token + run < end[token])
        inner[inner] = again[token[inner] + run] - again[token[inner] - 1] == run + 1
        token, left, right = token[~inner], left[~inner], right[~inner]
        around = _around(words, begin[token], end[token], token, _reach(span))
        other = np.zeros(len(token), np.int32)
        for turn, (k, start) in enumerate(((half, token), (half + SHINGLE, token - half))):
            good = (start >= begin[token]) & (start + k <= end[token])
            rows = np.zeros(int(good.sum()), _WINDOW)
            rows["key"] = mix(words.grams(k)[start[good]] + np.uint64(2 * i + turn)).view(np.int64)
            rows["other"] = other[good]
            if not turn:
                other[good] = rows["key"] >> 32 | 1
            rows["around"], rows["at"], rows["left"], rows["right"] = around[good], (token - begin[token])[good], left[good], right[good]
            docs.append(of[token][good])
            parts.append(rows)
    return np.concatenate(docs), np.concatenate(parts)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, words_key (128-bit hash of the words) of each document."""

    def run(batches):
        for batch in batches:
            n, keys = [], []
            for _, group in grouped(strings(batch.column(1))):
                words = Words(group, "space")
                n += np.diff(words.of).tolist()
                keys += [hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=16).digest() for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_words", "words_key"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, words_key binary")


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(key, around, doc, place, other) of the windows of all documents; place packs token and room on both sides."""
    def pack(docs, rows):
        place = rows["at"] << 2 * _ROOM | rows["left"] << _ROOM | rows["right"]
        return pa.record_batch([pa.array(x) for x in (rows["key"], rows["around"], docs, place, rows["other"])], names=["key", "around", "doc", "place", "other"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, first = batch.column(0).to_numpy(), 0
            for _, group in grouped(strings(batch.column(1))):
                of, rows = _keyed(Words(group, "space"), span)
                held.append((ids[first + of], rows))
                first, size = first + len(group), size + len(rows)
                if size >= BATCH_WINDOWS:
                    yield pack(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if size:
            yield pack(*(np.concatenate(x) for x in zip(*held)))

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, around long, doc long, place long, other int")


def _meet(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether the intervals of two windows, laid over each other at the token, hold so many tokens."""
    room = (1 << _ROOM) - 1
    return np.minimum(a >> _ROOM & room, b >> _ROOM & room) + np.minimum(a & room, b & room) >= least


def met(rows: DataFrame, least: int) -> DataFrame:
    """Windows that meet, from rows clustered by key in the order of (around, doc).

    (doc, lead, key, place, other): pairs to verify, a window with the first whose words around are
    the same, and all pairs of up to HOT different ones; rows with a key are the different
    ones of keys that have more.
    """
    names, kinds = ["doc", "lead", "key", "place", "other"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def groups(key, around, doc, place, other):
        """What comes of whole groups."""
        new = np.concatenate([[True], key[1:] != key[:-1]])
        differ = new | np.concatenate([[True], around[1:] != around[:-1]])
        lead = doc[np.maximum.accumulate(np.where(differ, np.arange(len(key)), 0))]
        same = np.flatnonzero((doc != lead) & (other == 0))
        yield doc[same], lead[same], None, None, None
        key, doc, place, other, new = key[differ], doc[differ], place[differ], other[differ], new[differ]
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(key)))
        least_other = np.minimum.reduceat(other, at)
        several = np.repeat((np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)) & ((least_other < np.maximum.reduceat(other, at)) | (least_other == 0)), many)
        many = np.repeat(many, many)
        for k in range(1, HOT):
            i = np.flatnonzero((many[k:] <= HOT) & (key[k:] == key[:-k]) & (doc[k:] != doc[:-k])) if len(key) > k else at[:0]
            i = i[_meet(place[i], place[i + k], least) & ((other[i] != other[i + k]) | (other[i] == 0))]
            yield np.maximum(doc[i], doc[i + k]), np.minimum(doc[i], doc[i + k]), None, None, None
        hot = np.flatnonzero(several & (many > HOT))
        if not len(hot):
            return
        # of few documents, or few beside their windows, all pairs
        order = hot[np.lexsort((doc[hot], key[hot]))]
        fresh = order[np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])])]
        _, start, docs = np.unique(key[fresh], return_index=True, return_counts=True)
        few = docs * (docs - 1) // 2 <= PAIRS * many[fresh[start]]
        for size in np.unique(docs[few]).tolist():
            at = start[few & (docs == size)]
            a, b = np.triu_indices(size, 1)
            yield doc[fresh[at[:, None] + b]].ravel(), doc[fresh[at[:, None] + a]].ravel(), None, None, None
        hot = hot[~np.isin(key[hot], key[fresh[start[few]]])]
        yield doc[hot], doc[hot], key[hot], place[hot], other[hot]

    def run(batches):
        held = []  # rows of the last key, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held and columns[0][0] == columns[0][-1] == held[-1][0][-1]:
                held.append(columns)
                continue
            columns = [np.concatenate(x) for x in zip(*held, columns)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [[x[last:] for x in columns]]
            yield from pack([x[:last] for x in columns])
        if held:
            yield from pack([np.concatenate(x) for x in zip(*held)])

    def pack(columns):
        for out in groups(*columns) if len(columns[0]) else ():
            if len(out[0]):
                yield pa.record_batch([pa.nulls(len(out[0]), t) if c is None else pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return rows.mapInArrow(run, "doc long, lead long, key long, place long, other int")


def sharing(crowd: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """Rows of crowd, those alone whose window holds a run that is in a window of another document under the same key."""
    run = min(span, RUN)
    least, room = run - SHINGLE + 1, (1 << _ROOM) - 1
    rows = crowd.groupBy("doc").agg(F.collect_list("key").alias("keys"), F.collect_list("place").alias("places"), F.collect_list("other").alias("others")).join(texts, "doc").select("doc", "text", "keys", "places", "others")

    def runs(batches):
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), batch.column(2).offsets.to_numpy()
            key, place, other = (batch.column(c).values.to_numpy() for c in (2, 3, 4))
            for first, group in grouped(strings(batch.column(1))):
                words = Words(group, "space")
                grams = words.grams(run)
                lo, hi = at[first], at[first + len(group)]
                text = np.repeat(np.arange(len(group)), np.diff(at[first : first + len(group) + 1]))
                token = words.of[text] + (place[lo:hi] >> 2 * _ROOM)
                for k in range(least):
                    # a run that begins k words before the token
                    good = np.flatnonzero((place[lo:hi] >> _ROOM & room >= k) & (place[lo:hi] & room >= least - k) & (token - k + run <= words.of[text + 1]))
                    if len(good):
                        x = lo + good
                        h = mix(mix(grams[token[good] - k] + np.uint64(k)) ^ key[x].view(np.uint64)).view(np.int64)
                        yield pa.record_batch([pa.array(c) for c in (h, key[x], ids[first + text[good]], place[x], other[x])], names=["run", "key", "doc", "place", "other"])

    rows, same = rows.mapInArrow(runs, "run long, key long, doc long, place long, other int"), Window.partitionBy("run")
    for c in ("doc", "other"):
        rows = rows.withColumn(f"_{c}", F.min(c).over(same)).withColumn(f"{c}_", F.max(c).over(same))
    return rows.filter("_doc < doc_ and (_other < other_ or _other = 0)").select("key", "doc", "place", "other").distinct()


def neighbourhoods(crowd: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """(key, doc, place, other, left, words): 32-bit hashes of the words around each window, and how many are before its token."""
    reach = _reach(span)
    rows = crowd.groupBy("doc").agg(F.collect_list(F.struct("key", "place", "other")).alias("places")).join(texts, "doc").select("doc", "text", "places")

    def run(batches):
        for batch in batches:
            ids, places, out, size = batch.column(0).to_pylist(), batch.column(2), [], 0
            for first, group in grouped(strings(batch.column(1))):
                words = Words(group, "space")
                short = (words.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                for k in range(len(group)):
                    a, b = int(words.of[k]), int(words.of[k + 1])
                    for p in places[first + k].as_py():
                        t = a + (p["place"] >> 2 * _ROOM)
                        if t >= b:  # of a repeated row with other words
                            continue
                        lo = max(a, t - reach)
                        out.append((p["key"], ids[first + k], p["place"], p["other"], t - lo, short[lo : min(b, t + reach)].tobytes()))
                        size += len(out[-1][5])
                    if size > 1 << 23:
                        yield pack(out)
                        out, size = [], 0
            if out:
                yield pack(out)

    def pack(out):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["key", "doc", "place", "other", "left", "words"])

    return rows.mapInArrow(run, "key long, doc long, place long, other int, left int, words binary")


@lru_cache(maxsize=4)
def _parts(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shingles that a passage has in common at least) of the stretches of so many shingles or more."""
    p, q = np.triu_indices(n, size)
    return p, q, np.maximum(SIMILARITY / (1 + SIMILARITY) * (q - p + size), SIMILARITY * (q - p)) - 1e-9


class Crowd:
    """The windows of one key."""

    def __init__(self, span: int):
        self.span, self.run, self.side = span, min(span, RUN), _reach(span)
        self.least = self.run - SHINGLE + 1
        self.docs, self.places, self.others, self.lefts, self.words = [], [], [], [], []

    def add(self, *window) -> None:
        for held, x in zip((self.docs, self.places, self.others, self.lefts, self.words), window):
            held.append(x)

    def _text(self, i: int) -> Text:
        if i not in self._texts:
            if len(self._texts) >= BLOCK:
                self._texts.clear()
            self._texts[i] = Text(np.frombuffer(self.words[i], np.uint32).astype(np.uint64))
        return self._texts[i]

    def _prepare(self) -> None:
        """Words and shingles on both sides of the token; 0 where the text has none."""
        n, side = len(self.docs), self.side
        self._texts, self.passages = {}, {}
        self.doc, self.place, self.other = np.array(self.docs), np.array(self.places), np.array(self.others)
        self.w = np.zeros((n, 2 * side), np.uint32)
        for i, (left, words) in enumerate(zip(self.lefts, self.words)):
            x = np.frombuffer(words, np.uint32)[max(0, left - side) : left + side]
            self.w[i, side - min(left, side) :][: len(x)] = x
        self.halves = self.w[:, [side - self.run // 2, side + self.run // 2]]
        m = 2 * side - SHINGLE + 1
        good, h = np.ones((n, m), bool), np.zeros((n, m), np.uint32)
        for k in range(SHINGLE):
            good &= self.w[:, k : k + m] != 0
            h = (h * np.uint32(0x9E3779B1)) ^ self.w[:, k : k + m]
        self.s = np.zeros_like(self.w)
        self.s[:, :m] = np.where(good, h | np.uint32(1), 0)
        # a shingle of its own, first within a span; none where the text has no shingle
        order = np.argsort(self.s, 1, kind="stable")
        sorted_ = np.take_along_axis(self.s, order, 1)
        again = np.zeros(self.s.shape, bool)
        again[:, 1:] = (sorted_[:, 1:] == sorted_[:, :-1]) & (np.diff(order, axis=1) < self.span - SHINGLE + 1)
        self.fresh = np.empty_like(again)
        np.put_along_axis(self.fresh, order, ~again, 1)
        self.fresh = np.where(self.s == 0, np.int32(4 * side), self.fresh)

    def _linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others that share a passage with i."""
        side, size = self.side, self.span - SHINGLE + 1
        others = others[(self.doc[others] != self.doc[i]) & ((self.other[others] != self.other[i]) | (self.other[i] == 0)) & _meet(self.place[others], self.place[i], self.least)]
        # a run with the token holds the word half a run before or behind it
        others = others[((self.halves[others] == self.halves[i]) & (self.halves[i] != 0)).any(1)]
        if not len(others):
            return others
        # the verbatim run at the token
        differ = (self.w[others] != self.w[i]) | (self.w[i] == 0)
        right, left = differ[:, side:].argmax(1), differ[:, side - 1 :: -1].argmax(1)
        right[~differ[:, side:].any(1)] = side
        left[~differ[:, :side].any(1)] = side
        common = left + right >= self.run
        others, left, right, differ = others[common], left[common], right[common], None
        verbatim = left + right >= self.span
        out, rest = [others[verbatim]], np.flatnonzero(~verbatim)
        # a run that is long enough with words that differ, or a shingle within a gap of its ends
        near, k = (left + right)[rest] - SHINGLE + 1 >= _common(self.span, SIMILARITY), np.arange(_gap(self.span) + 1)
        for ends, steps in ((side + right[rest], k), (side - left[rest] - SHINGLE, -k)):
            todo = np.flatnonzero(~near)
            if not len(todo):
                break
            at = ends[todo][:, None] + steps
            good = (at >= 0) & (at < 2 * side)
            at = np.clip(at, 0, 2 * side - 1)
            mine, theirs = self.s[i][at], self.s[others[rest[todo]][:, None], at]
            # 31 bits of a shingle, odd where there is one: equal ones by chance only go on to verification
            mine, theirs = (np.where(good & (x != 0), x.astype(np.uint32) | np.uint32(1), none) for x, none in ((mine, np.uint32(0)), (theirs, np.uint32(2))))
            near[todo[(mine[:, :, None] == theirs[:, None, :]).reshape(len(todo), -1).any(1)]] = True
        rest = rest[near]
        if not len(rest):
            return out[0]
        # words that differ one for one: a span with enough shingles in place is a passage
        mine = self.s[i]
        alike = (self.s[others[rest]] == mine) & (mine != 0)
        total = np.cumsum(alike, 1, dtype=np.int32)
        plain = (total[:, size:] - total[:, :-size]).max(1) >= _common(self.span, SIMILARITY)
        some = mine[mine != 0]
        plain &= len(np.unique(some)) == len(some)
        out.append(others[rest[plain]])
        # common shingles on both sides that gaps can join to a passage's size
        rest = others[rest[~plain]]
        values, which = np.unique(mine, return_inverse=True)
        theirs = self.s[rest]
        place = np.minimum(np.searchsorted(values, theirs), len(values) - 1)
        theirs = (values[place] == theirs) & (theirs != 0)
        row = np.nonzero(theirs)[0]
        found = np.zeros((len(rest), len(values)), bool)
        found[row, place[theirs]] = True
        # no more shingles of its own in some span than a quarter of the common ones
        most, found = found.sum(1) * (1 / SIMILARITY - 1) + 1e-9, found[:, which]
        good = np.ones(len(rest), bool)
        for x, fresh in ((theirs, self.fresh[rest]), (found, self.fresh[i])):
            total = np.zeros((len(rest), 2 * side + 1), np.int32)
            np.cumsum(np.where(x, 0, fresh), 1, out=total[:, 1:])
            good &= (total[:, size:] - total[:, :-size]).min(1) <= most
        good = np.flatnonzero(good)
        # of a passage's own shingles so many are in the other: those of a like span, or, where that is shorter, SIMILARITY of them
        whole = len(values) - (values[0] == 0) == len(some)
        p, q, enough = _parts(2 * side - SHINGLE + 2, size)
        for j, f in zip(rest[good].tolist(), found[good]):
            if whole:
                total = np.append(0, np.cumsum(f))
                if not (total[q] - total[p] >= enough).any():
                    continue
            if passages := verify(self._text(i), self._text(j), self.span):
                self.passages[i, j] = passages
                out.append(np.array([j]))
        return np.concatenate(out)

    def _links(self, i: int, j: int) -> list[tuple]:
        a, b = ((self.places[k] >> 2 * _ROOM) - self.lefts[k] for k in (i, j))
        rows = [(a + x[0], a + x[1], b + x[2], b + x[3], x[4]) for x in self.passages.get((i, j), ())] or [(None,) * 5]
        if self.docs[i] < self.docs[j]:
            rows = [(*x[2:4], *x[:2], x[4]) for x in rows]
        return [(max(self.docs[i], self.docs[j]), min(self.docs[i], self.docs[j]), *x) for x in rows]

    def links(self) -> list[tuple]:
        """(doc, lead, passage): links that connect all windows that are linked, with the passages that verify() gave here.

        Breadth first: each window is held against all that nothing has reached yet.
        """
        self._prepare()
        out, left, reached = [], np.arange(len(self.docs)), []
        while len(left):
            i = reached.pop() if reached else int(left[0])
            left = left[left != i]
            for lo in range(0, len(left), BLOCK):
                found = self._linked(i, left[lo : lo + BLOCK]).tolist()
                for j in found:
                    out += self._links(i, j)
                reached += found
            left = left[~np.isin(left, reached)] if reached else left
        return out


def connected(rows: DataFrame, span: int) -> DataFrame:
    """OUT: links that connect the windows of each key, from neighbourhoods() clustered by key; without a passage where none had to be searched for."""
    def run(batches):
        at, crowd = None, None
        for batch in batches:
            out = []
            for key, *window in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    out += crowd.links() if crowd else []
                    at, crowd = key, Crowd(span)
                crowd.add(*window)
            if out:
                yield pack(out)
        if crowd and (out := crowd.links()):
            yield pack(out)

    def pack(out):
        kinds = [pa.int64()] * 6 + [pa.float64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)


def candidate_pairs(found_in: DataFrame, reps: DataFrame, texts: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(doc, lead): the pairs to verify, from windows(); reps (doc_id, rep) names the first of
    the documents with the same words.  And OUT: the passages known already."""
    rows = found_in.repartition("key").sortWithinPartitions("key", "around", "doc", "place")
    found = workspace.Table(met(rows, min(span, RUN) - SHINGLE + 1), "met").df
    around = neighbourhoods(sharing(found.filter("key is not null").select("key", "doc", "place", "other"), texts, span), texts, span)
    linked = workspace.Table(connected(around.repartition("key").sortWithinPartitions("key", "doc", "place"), span), "connected").df
    pairs = found.filter("key is null").select("doc", "lead").union(linked.select("doc_id", "partner_id")).distinct()
    named = lambda c: reps.select(F.col("doc_id").alias(f"_{c}"), F.col("rep").alias(f"{c}_rep"))
    both = lambda rows, d, p: rows.join(named("doc"), F.col(d) == F.col("_doc")).join(named("lead"), F.col(p) == F.col("_lead")).filter("doc_rep <> lead_rep")
    known = both(linked.filter("start_word is not null"), "doc_id", "partner_id").select(F.col("doc_rep").alias("doc_id"), F.col("lead_rep").alias("partner_id"), *linked.columns[2:])
    return both(pairs, "doc", "lead").select(F.greatest("doc_rep", "lead_rep").alias("doc"), F.least("doc_rep", "lead_rep").alias("lead")).distinct(), known


class Hashes(Words):
    """Words of which only the hashes are known."""

    def __init__(self, hashes: np.ndarray):
        self.hash = hashes

    def __len__(self) -> int:
        return len(self.hash)


class Text:
    """Words and shingles of one text, or of hashes of words."""

    def __init__(self, text: bytes | np.ndarray):
        w = Words([text], "space") if isinstance(text, bytes) else Hashes(text)
        self.words, self.grams = w.hash, w.grams(SHINGLE)
        self.order = np.argsort(self.grams, kind="stable")
        self.sorted = self.grams[self.order]
        self.distinct = bool((self.sorted[1:] != self.sorted[:-1]).all())
        self._words, self._spans, self._lead = w, {}, None

    def places(self, lead: Text) -> np.ndarray:
        """The place of each shingle in a lead of distinct ones, -1 where it isn't there."""
        if self._lead is not lead:
            at = np.minimum(np.searchsorted(lead.sorted, self.grams), len(lead.sorted) - 1)
            self._lead, self._places = lead, np.where(lead.sorted[at] == self.grams, lead.order[at], -1) if len(lead.sorted) else np.full(len(at), -1)
        return self._places

    def spans(self, span: int) -> np.ndarray:
        """Hash of the span of words from each position."""
        if span not in self._spans:
            self._spans[span] = self._words.grams(span)
        return self._spans[span]

    def has(self, keys: np.ndarray, span: int) -> np.ndarray:
        """Which of the hashes are those of its spans."""
        if -span not in self._spans:
            self._spans[-span] = np.unique(self.spans(span))
        mine = self._spans[-span]
        return mine[np.minimum(np.searchsorted(mine, keys), len(mine) - 1)] == keys if len(mine) else np.zeros(len(keys), bool)


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        k = min(step, n - done)
        differ = a[done : done + k] != b[done : done + k]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + k, step * 2
    return n


def _joined(row: np.ndarray, at: np.ndarray, span: int, similarity: float) -> np.ndarray:
    """Rows with common shingles, at these places in order, that a passage can be made of: runs and gaps of a span, or as many shingles as two runs need."""
    if not len(at):
        return row
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] - at[:-1] > _gap(span, similarity) + SHINGLE)]))
    last = np.append(first[1:], len(at)) - 1
    return np.unique(row[first[(at[last] - at[first] + SHINGLE >= span) | (last - first + 1 >= _common(span, similarity))]])


def _may_hold(doc: Text, lead: Text, span: int, similarity: float = SIMILARITY) -> bool:
    """Whether the shingles in common can make a passage in both; if not, verify() gives none."""
    for x, y in ((doc, lead), (lead, doc)):
        if not len(x.grams) or not len(y.grams):
            return False
        if doc.distinct and lead.distinct:
            at = doc.places(lead)
            at = np.flatnonzero(at >= 0) if x is doc else np.sort(at[at >= 0])
        else:
            at = np.flatnonzero(y.sorted[np.minimum(np.searchsorted(y.sorted, x.grams), len(y.sorted) - 1)] == x.grams)
        if not len(_joined(np.zeros_like(at), at, span, similarity)):
            return False
    return True


def exact_runs(doc: Text, lead: Text) -> list[tuple[int, int, int]]:
    """(start, start in lead, words) of common runs in order of the doc: at each place the
    longest there is, at least SHINGLE words."""
    out, done = [], 0
    if lead.distinct:
        there = doc.places(lead)
        hits = np.flatnonzero(there >= 0)
        there = there[hits]
    else:
        lo, hi = np.searchsorted(lead.sorted, doc.grams, "left"), np.searchsorted(lead.sorted, doc.grams, "right")
        hits = np.flatnonzero(hi > lo)
        there = lead.order[lo[hits]] if len(hits) and (hi - lo).max() == 1 else None
    if not len(hits):
        return out
    if there is not None:  # one place for each: runs are neighbours in both
        new = np.flatnonzero((np.diff(hits) != 1) | (np.diff(there) != 1)) + 1
        first = np.append(0, new)
        for i, j, last in zip(hits[first].tolist(), there[first].tolist(), hits[np.append(new, len(hits)) - 1].tolist()):
            at = max(i, done)
            if at <= last:
                done = last + SHINGLE
                out.append((at, j + at - i, done - at))
        return out
    for i in hits.tolist():
        if i < done:
            continue
        at = lead.order[lo[i] : hi[i]]
        if len(at) > 1 and out and out[-1][0] + out[-1][2] <= i:  # else the one that goes on where the last run ended
            at = at[np.argsort(np.abs((at - i) - (out[-1][1] - out[-1][0])), kind="stable")]
        best, where = 0, 0
        for j in at.tolist():
            if len(doc.words) - i <= best:
                break
            if best and (j + best >= len(lead.words) or lead.words[j + best] != doc.words[i + best]):
                continue
            n = _run(doc.words[i:], lead.words[j:])
            if n > best:
                best, where = n, j
        out.append((i, where, best))
        done = i + best
    return out


def _jaccard(doc: Text, lead: Text, a: int, b: int, c: int, d: int) -> float:
    if doc.distinct and lead.distinct:
        x, hi = doc.places(lead)[a : max(a + 1, b - SHINGLE + 1)], min(max(c + 1, d - SHINGLE + 1), len(lead.grams))
        both = int(np.count_nonzero((x >= c) & (x < hi)))
        return both / (len(x) + hi - c - both)
    x, y = np.unique(doc.grams[a : max(a + 1, b - SHINGLE + 1)]), np.unique(lead.grams[c : max(c + 1, d - SHINGLE + 1)])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


@lru_cache(maxsize=FEW_RUNS)
def _triangle(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m)


def _best_part(doc: Text, lead: Text, chain: list[tuple[int, int, int]], span: int, similarity: float) -> tuple[int, int] | None:
    """The longest part [p, q) of a failing chain worth testing, None if there is none.

    Whole runs only: to cut one takes common shingles away.  Few runs: all parts, on the
    shingles themselves.  Many: with shingles counted with repeats the condition is a sum
    over runs and gaps, (1 + s) * common >= s * (both sides), so for each end the first
    start that holds is found in sorted minima.
    """
    m = len(chain)
    start, end = np.array([(i, j) for i, j, _ in chain]), np.array([(i + n, j + n) for i, j, n in chain])
    if m <= FEW_RUNS:
        p, q = _triangle(m)
        size = end[q] - start[p]
        good = (q - p + 1 < m) & (size.min(1) >= span)
        x, y = (t.grams[start[0, k] : end[-1, k] - SHINGLE + 1] for k, t in enumerate((doc, lead)))
        if doc.distinct and lead.distinct:
            there = doc.places(lead)[start[0, 0] : end[-1, 0] - SHINGLE + 1]
            hits = (there >= start[0, 1]) & (there < end[-1, 1] - SHINGLE + 1)
        else:
            hits = np.isin(x, y) if len(np.unique(x)) == len(x) and len(np.unique(y)) == len(y) else None
        if hits is not None:  # the shingles of a part that are in the other chain at all
            hits = np.append(0, np.cumsum(hits))
            most = hits[end[q, 0] - start[0, 0] - SHINGLE + 1] - hits[start[p, 0] - start[0, 0]]
            good &= (1 + similarity) * most >= similarity * (size.sum(1) - 2 * (SHINGLE - 1)) - 1e-9
        parts = np.flatnonzero(good)
        parts = parts[np.argsort(-size[parts].sum(1), kind="stable")].tolist()
        return next(((p, q) for p, q in zip(p[parts].tolist(), (q[parts] + 1).tolist()) if _jaccard(doc, lead, start[p, 0], end[q - 1, 0], start[p, 1], end[q - 1, 1]) >= similarity), None)
    common = np.append(0, np.cumsum([n - SHINGLE + 1 for _, _, n in chain]))
    left = (1 + similarity) * common[:-1] - similarity * start.sum(1)
    right = (1 + similarity) * common[1:] - similarity * (end.sum(1) - 2 * (SHINGLE - 1)) + 1e-9
    first = np.searchsorted(-np.minimum.accumulate(left), -right, "left")
    ends = np.flatnonzero(first <= np.arange(m))
    ends = ends[(end[ends] - start[first[ends]]).min(1) >= span] if len(ends) else ends
    if not len(ends):
        return None
    q = int(ends[np.argmax((end[ends] - start[first[ends]]).sum(1))])
    p = int(first[q])
    if q - p + 1 == m:  # repeats count once in the similarity: go on with what lies on one side of the widest gap
        return 0, int(np.argmax((start[1:] - end[:-1]).sum(1))) + 1
    return p, q + 1


def _common(span: int, similarity: float) -> float:
    """Shingles that two spans of that similarity have in common at least."""
    return 2 * similarity / (1 + similarity) * (span - SHINGLE + 1) - 1e-9


def _widened(doc: Text, lead: Text, chain: list[tuple[int, int, int]], span: int, similarity: float) -> tuple[int, int, tuple] | None:
    """(p, q, passage): a run, or two neighbours, shorter than a span, that passes together with words that differ beside it.

    More than one break costs a span too many shingles.
    """
    for k in (2, 1):
        for p in range(len(chain) - k + 1):
            (a, c, _), (i, j, n) = chain[p], chain[p + k - 1]
            if sum(x[2] - SHINGLE + 1 for x in chain[p : p + k]) < _common(span, similarity) or min(len(doc.words), len(lead.words)) < span:
                continue
            ends = []
            for lo, hi, size in ((a, i + n, len(doc.words)), (c, j + n, len(lead.words))):
                hi = max(hi, min(size, lo + span))
                ends += [max(0, min(lo, hi - span)), hi]
            if (s := _jaccard(doc, lead, *ends)) >= similarity:
                return p, p + k, (*ends, s)
    return None


def _passages(doc: Text, lead: Text, chain: list[tuple[int, int, int]], span: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """The passages of a chain of runs: the whole, or its longest parts that pass."""
    out, stack = [], [chain]
    while stack:
        part = stack.pop()
        if not part:
            continue
        (a, c, _), (i, j, n) = part[0], part[-1]
        if min(i + n - a, j + n - c) >= span:
            if (s := _jaccard(doc, lead, a, i + n, c, j + n)) >= similarity:
                out.append((a, i + n, c, j + n, s))
                continue
            if len(part) > 1 and (cut := _best_part(doc, lead, part, span, similarity)):
                stack += [part[: cut[0]], part[cut[0] : cut[1]], part[cut[1] :]]
                continue
        if wide := _widened(doc, lead, part, span, similarity):
            out.append(wide[2])
            stack += [part[: wide[0]], part[wide[1] :]]
    return out


def _left_out(doc: Text, lead: Text, found: list[tuple[int, int, int, int, float]], span: int) -> list[tuple[int, int, int, int, float]]:
    """Verbatim passages that no found one holds: a run that goes on elsewhere in the lead can hide their start.

    Where no shingle repeats, runs can't hide each other: every run of a span is found.
    """
    if doc.distinct and lead.distinct:
        return []
    mine, theirs = doc.spans(span), lead.spans(span)
    if not len(mine) or not len(theirs):
        return []
    bare = lead.has(mine, span)
    for a, b, *_ in found:
        bare[a : max(a, b - span + 1)] = False
    out, done = [], 0
    for k in np.flatnonzero(bare).tolist():
        if k < done:
            continue
        best, where = 0, 0
        for j in np.flatnonzero(theirs == mine[k]).tolist():
            if k + best >= len(doc.words):
                break
            if best and (j + best >= len(lead.words) or lead.words[j + best] != doc.words[k + best]):
                continue
            n = _run(doc.words[k:], lead.words[j:])
            if n > best:
                best, where = n, j
        if best >= span:
            out.append((k, k + best, where, where + best, 1.0))
            done = k + best - span + 1
    return out


def verify(doc: Text, lead: Text, span: int = SPAN, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(start, end, lead_start, lead_end, similarity) of the passages, in words."""
    chains, gap = [], _gap(span, similarity)
    for i, j, n in exact_runs(doc, lead):
        if chains:
            pi, pj, pn = chains[-1][-1]
            if 0 <= i - pi - pn <= gap and 0 <= j - pj - pn <= gap:
                chains[-1].append((i, j, n))
                continue
        chains.append([(i, j, n)])
    out = []
    for chain in chains:
        out += _passages(doc, lead, chain, span, similarity)
    return sorted(out + _left_out(doc, lead, out, span))


OUT = "doc_id long, partner_id long, start_word long, end_word long, partner_start long, partner_end long, similarity double"


def verified(pairs: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """Passages of documents against their leaders."""
    salts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(salts, "lead").select("lead", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), "doc")
    leads = salts.select("lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("lead").alias("doc"))
    rows = members.union(leads).join(texts, "doc").select("lead", "salt", "member", "doc", "text")
    rows = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "member")

    def run(batches):
        at, leads = None, []
        for batch in batches:
            out = []
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            for first, group in grouped(strings(batch.column(4))):
                words = Words(group, "space")
                for (lead, salt, member, doc), a, b in zip(ids[first : first + len(group)], words.of[:-1].tolist(), words.of[1:].tolist()):
                    if (lead, salt) != at:
                        at, leads = (lead, salt), []
                    text = Text(words.hash[a:b].copy())
                    if not member:
                        leads.append(text)
                        continue
                    for other in leads:
                        if _may_hold(text, other, span):
                            out += [(doc, lead, *x) for x in verify(text, other, span)]
            if out:
                kinds = [pa.int64()] * 6 + [pa.float64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)


def classes(links: DataFrame) -> DataFrame:
    """A row for each place of a passage but the first of its class, which is its partner.

    Passages of a document that overlap by a shingle or more are one place.
    """
    sides = [links.select(F.col(d).alias("doc"), F.col(a).alias("start"), F.col(b).alias("end"), "similarity") for d, a, b in (("doc_id", "start_word", "end_word"), ("partner_id", "partner_start", "partner_end"))]
    spans = sides[0].union(sides[1]).groupBy("doc", "start", "end").agg(F.max("similarity").alias("similarity"))
    before = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("_end", F.max("end").over(before))
    spans = spans.withColumn("place", F.last(F.when(F.col("_end").isNull() | (F.col("start") > F.col("_end") - SHINGLE), F.col("start")), True).over(upto))
    spans = workspace.Table(spans.select("doc", "start", "end", "similarity", F.struct("doc", F.col("place").alias("start")).alias("node")), "spans").df
    named = lambda c, d, a, b: spans.select(F.col("doc").alias(d), F.col("start").alias(a), F.col("end").alias(b), F.col("node").alias(c))
    edges = links.join(named("x", "doc_id", "start_word", "end_word"), ["doc_id", "start_word", "end_word"]).join(named("y", "partner_id", "partner_start", "partner_end"), ["partner_id", "partner_start", "partner_end"])
    label, _ = near_dup.components(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b"))
    places = spans.groupBy("node").agg(F.max("end").alias("end"), F.max("similarity").alias("similarity"))
    first = places.select(F.col("node").alias("component"), F.col("end").alias("partner_end"))
    rows = places.join(label.withColumnRenamed("rep", "node"), "node").filter("node <> component").join(first, "component")
    return rows.select(
        F.col("node.doc").alias("doc_id"), F.col("component.doc").alias("partner_id"), F.col("node.start").alias("start_word"), F.col("end").alias("end_word"),
        F.col("component.start").alias("partner_start"), "partner_end", "similarity",
    )


def find_passages(docs: DataFrame, *, span: int = SPAN) -> DataFrame:
    """A row for each place of a passage that is not the first of its class: doc_id, start_word,
    end_word; the first place, as partner_id, partner_start, partner_end; and the highest
    similarity of the place's verified links.

    Partner and first word name the class: all places that links of SIMILARITY or more
    connect, in whatever texts.  A document whose words equal those of another is a row with
    the first such document as partner, over all its words, and nothing else: the first
    stands for it.  Null, empty and shorter texts share nothing; rows without doc_id are left
    out; rows that repeat a document with other words are compared as they are.  Other
    columns are ignored.
    """
    workspace.ship(docs.sparkSession)
    described = workspace.Table(describe(docs), "passages").df.filter(F.col("n_words") >= span)
    alike = described.groupBy("words_key").agg(F.min("doc_id").alias("rep"))
    reps = workspace.Table(described.join(alike, "words_key").select("doc_id", "n_words", "rep").distinct(), "reps").df
    copies = reps.filter("doc_id <> rep").select(
        "doc_id", F.col("rep").alias("partner_id"), F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"),
        F.lit(0).cast("long").alias("partner_start"), F.col("n_words").alias("partner_end"), F.lit(1.0).alias("similarity"),
    )
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    pairs, known = candidate_pairs(windows(docs, span), reps.select("doc_id", "rep"), texts, span)
    links = workspace.Table(verified(workspace.Table(pairs, "pairs").df, texts, span).distinct(), "verified").df
    # in a text that repeats its words a passage can show among the words around a window alone
    sure = links.select(F.col("doc_id").alias("_doc"), F.col("partner_id").alias("_lead")).distinct()
    known = known.join(sure, (F.greatest("doc_id", "partner_id") == F.col("_doc")) & (F.least("doc_id", "partner_id") == F.col("_lead")), "left_anti")
    links = links.union(workspace.Table(known.distinct(), "known").df)
    return classes(links).union(copies).distinct()
