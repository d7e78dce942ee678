"""Personal data: patterns, and a linear-chain conditional random field that adds what they miss.

The field labels tokens with a kind or none. Its features are the shapes of a token and of its neighbours, and a few cue words; it
is trained here from the small table below by gradient ascent on the conditional likelihood. Viterbi runs over numpy batches of sequences
of like length.

Its labels are those of the whole text, though most tokens are never decoded: ``margin`` proves from the weights, after training, that a
token far enough inside a run of plain words has no label on the best path, whatever stands around the run. The path
falls apart there, so only the stretches between are decoded, from no label to no label.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free, pieces, ship, table

KINDS = ("email", "ip", "card", "phone")

#: The labelled table: ``[kind:text]`` marks a span, the rest is unlabelled.
LABELLED = """
call me on [phone:(743) 555-3824] after six
phone [phone:743-555-3824] or write
tel. [phone:743.555.3824] in the office
my number is [phone:020 7946 0958] , thanks
reach us : [phone:555-019-2834] today
fax [phone:(212) 555 0147] and post
mobile [phone:07700 900 123] evenings
ring [phone:1-800-555-0199] toll free
you can call [phone:303 555 0112] or come
the and of [phone:(608) 555-4949] that on
tel [phone:06 12 34 56 78] merci
telefon [phone:030 901820 44] bitte
write to [email:jane dot roe at example dot com] please
mail [email:jane.roe (at) example.com] now
email [email:jane [at] example [dot] org] for more
contact [email:bob at mail dot example dot net] today
send it to [email:info@example.com] soon
the [email:x.y@mail.example] and of
is [email:sam_lee(at)example.org] right
server [ip:10.0.0.7] is down
from [ip:192.168.10.25] to [ip:172.16.0.3] it went
card [card:4111 1111 1111 1111] expires
visa [card:4111-1111-1111-1111] was used
pay with [card:5500.0000.0000.0004] , she said
credit card no. [card:4111111111111111] ok
number [card:3782 822463 10005] amex
it rained at noon in 2019 and 2020
see section 4.2.1 of version 3.10.2
the price was 1,299.50 for 3 items
born 12-05-1987 or 1987-05-12 there
order 20190512-0034 shipped on 05/12/2019
chapter 7 page 123 line 45
we met at the dot on the map
look at example two and the dot below
score 3-2 after 90 minutes , 1-0 before
isbn 978-3-16-148410-0 is a book
from 1914 - 1918 and 1939 - 1945
room 101 floor 3 building 22
the ratio 0.75 of 12 to 16
id 4785380592391139 in the log
part no 555-01 of 12-34
on 24 12 2020 at 18 30
invoice 2020 1234 5678 paid
10 20 30 40 50 60 70
@home with the @team
sha 24be64439e3e49cf46b2d7c90f3602a3 here
the thon is and 42 of them
version 1.2.3.4.5 and 300.400.500.600
""".strip().split("\n")

_CUES = set("call phone tel telefon fax mobile ring number reach email mail write contact send card visa credit amex pay server ip from at dot to id order isbn version section invoice no".split())
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'<>{},;:!?$#%&*=|"


def _shape(w: str) -> str:
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", w, re.S):
        g = m.group()
        if g[0] in "0123456789":
            out.append("9" * min(len(g), 5) if len(g) < 13 else "N")
        elif g[0].isalpha():
            out.append("x")
        else:
            out.append(g)
    return "".join(out)


def _cue(w: str) -> str:
    return c if (c := w.lower().strip("()[].")) in _CUES else ""


def _own(w: str, shape: str, cue: str) -> list[str]:
    digits = sum(c.isdigit() for c in w)
    return ["b", "s=" + shape, "d=" + str(min(digits, 9)), "c=" + cue, "@" if "@" in w else "-", "p=" + w[0] if not w[0].isalnum() else "p"]


def _features(words: list[str]) -> list[list[str]]:
    shapes, cues = [_shape(w) for w in words], [_cue(w) for w in words]
    out = []
    for i, (w, s) in enumerate(zip(words, shapes, strict=True)):
        f = _own(w, s, cues[i])
        for k in (-2, -1, 1, 2):
            if 0 <= i + k < len(words):
                f += [f"s{k}={shapes[i + k]}", f"c{k}={cues[i + k]}"]
            else:
                f.append(f"s{k}=#")
        if i + 1 < len(words):
            f.append("ss=" + s + "_" + shapes[i + 1])
        if i:
            f.append("ps=" + shapes[i - 1] + "_" + s)
        out.append(f)
    return out


def _tokens(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _TOKEN.finditer(text):
        w = m.group()
        a = len(w) - len(w.lstrip(_EDGE))
        b = len(w.rstrip(_EDGE + "."))
        if b > a:
            out.append((m.start() + a, m.start() + b))
    return out


class Crf:
    """Weights of features and transitions; label 0 is none, label k is KINDS[k - 1]."""

    def __init__(self, index: dict[str, int], w: np.ndarray, t: np.ndarray):
        self.index, self.w, self.t = index, w, t
        self.kept: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}


    def _weights(self, features: list[str]) -> np.ndarray:
        return self.w[[self.index[x] for x in features if x in self.index]].sum(axis=0)

    def emissions(self, words: list[str]) -> np.ndarray:
        """[token, label]; the parts of a word, of a pair of shapes and of a pair of words two apart are kept, a bounded number of them."""
        n, kept = len(words), self.kept
        if not n:
            return np.zeros((0, self.w.shape[1]))
        if len(kept) > 200_000:
            kept.clear()
        out = np.zeros((n + 4, self.w.shape[1]))  # two places before the words and behind them
        known = []
        for i, w in enumerate(words):
            got = kept.get(w)
            if got is None:
                shape, cue = _shape(w), _cue(w)
                # What the word adds to itself and to its neighbours: to the word behind it it is at place -1.
                got = kept[w] = shape, np.array([self._weights([f"s{k}={shape}", f"c{k}={cue}"]) if k else self._weights(_own(w, shape, cue)) for k in (2, 1, 0, -1, -2)])
            out[i : i + 5] += got[1]
            known.append(got[0])
        out = out[2 : n + 2]
        for a, b in zip(range(n - 1), range(1, n)):
            pair = known[a], known[b]
            got = kept.get(pair)
            if got is None:
                got = kept[pair] = np.array([self._weights(["ss=" + "_".join(pair)]), self._weights(["ps=" + "_".join(pair)])])
            out[a : b + 1] += got
        for k in (-2, -1, 1, 2):  # the ends
            at = [i for i in range(n) if not 0 <= i + k < n]
            out[at] += self._weights([f"s{k}=#"])
        return out


def _rows() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED:
        text, spans, rest = "", [], line
        while m := re.search(r"\[(" + "|".join(KINDS) + r"):((?:[^\[\]]|\[[^\]]*\])*)\]", rest):
            text += rest[: m.start()]
            spans.append((len(text), len(text) + len(m[2]), KINDS.index(m[1]) + 1))
            text, rest = text + m[2], rest[m.end() :]
        text += rest
        toks = _tokens(text)
        out.append(([text[a:b] for a, b in toks], [next((k for s, e, k in spans if s <= a < e), 0) for a, b in toks]))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def gradient(w: np.ndarray, t: np.ndarray, ids: list[list[np.ndarray]], labels: list[list[int]], l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean conditional log-likelihood of the sequences, less l2 / 2 times the squares of all weights. ``ids``: the features of each token."""
    gw, gt = -l2 * w, -l2 * t
    for tok, y in zip(ids, labels, strict=True):
        e = np.array([w[i].sum(axis=0) for i in tok])
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0]
        for i in range(1, len(e)):
            a[i] = e[i] + _logsum(a[i - 1][:, None] + t, 0)
        for i in range(len(e) - 2, -1, -1):
            b[i] = _logsum(t + (e[i + 1] + b[i + 1])[None, :], 1)
        z = _logsum(a[-1], 0)
        p = np.exp(a + b - z)
        for i, f in enumerate(tok):
            d = -p[i]
            d[y[i]] += 1
            np.add.at(gw, f, d / len(ids))
            if i:
                gt -= np.exp(a[i - 1][:, None] + t + (e[i] + b[i])[None, :] - z) / len(ids)
                gt[y[i - 1], y[i]] += 1 / len(ids)
    return gw, gt


@lru_cache(1)
def trained(epochs: int = 120, rate: float = 0.1, l2: float = 0.003) -> Crf:
    """Fitted to the labelled table by Adam; the same on every run."""
    rows = _rows()
    feats = [_features(w) for w, _ in rows]
    index = {f: i for i, f in enumerate(sorted({x for s in feats for t in s for x in t}))}
    ids = [[np.array([index[x] for x in t]) for t in s] for s in feats]
    n = len(KINDS) + 1
    params = [np.zeros((len(index), n)), np.zeros((n, n))]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, epochs + 1):
        grads = gradient(*params, ids, [y for _, y in rows], l2)
        for p, g, (m, v) in zip(params, grads, moment, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(index, *params)


_SPACE, _LETTER, _TRIM, _DOT, _OTHER = range(5)


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: what it is in a token, and its lower-case form."""
    kind, low = np.full(0x110000, _OTHER, dtype=np.uint8), np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            kind[i] = _SPACE
        elif c.isalpha():
            kind[i], low[i] = _LETTER, ord(c.lower()[0])
    kind[[ord(c) for c in _EDGE]] = _TRIM
    kind[ord(".")] = _DOT
    return kind, low


def _packed(word: str) -> int:
    return sum(ord(c) << (8 * k) for k, c in enumerate(word))


def words(texts: list[str], cues: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of the words of all texts, joined by a line's end. Kind 0: a plain word of the field, letters alone between
    signs that are trimmed and no cue but one of ``cues``; 1: any other; 2: nothing but such signs, which is no token."""
    kind, low = _characters()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cls = kind[codes]
    word = np.zeros(len(cls) + 2, dtype=np.int8)
    word[1:-1] = cls != _SPACE
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.zeros(0, np.int8)
    letter = np.zeros(len(cls) + 2, dtype=np.int8)
    letter[1:-1] = cls == _LETTER
    edge = np.diff(letter)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # runs of letters
    at = np.searchsorted(first, start)
    runs = np.diff(np.append(at, len(first)))
    other = np.add.reduceat(cls == _OTHER, start, dtype=np.int32)
    out = np.ones(len(start), dtype=np.int8)
    out[(runs == 0) & (other == 0)] = 2
    one = np.flatnonzero((runs == 1) & (other == 0))
    a, b = first[at[one]], last[at[one]]
    dots = np.append(0, np.cumsum(cls == _DOT, dtype=np.int32))
    ok = dots[a] == dots[start[one]]  # a dot before the letters is not trimmed
    key, most = np.zeros(len(one), dtype=np.int64), max(map(len, _CUES))
    for k in range(most):
        here = a + k < b
        key[here] |= low[codes[a[here] + k]].astype(np.int64) << (8 * k)
    ok &= (b - a > most) | ~np.isin(key, [_packed(c) for c in _CUES - cues])
    out[one[ok]] = 0
    return start, end, out


def margin(crf: Crf, most: int = 12) -> tuple[int, frozenset[str]] | None:
    """(reach, cues): a token with ``reach`` plain words on either side has no label on the best path; plain are words of letters that
    are no cue, or one of ``cues``. None if that can't be proven.

    What a kind can gain over none at a plain word is bounded by its own features and, for each place around it, the most that any plain
    word or the end of the text can add. If even then every path with a label in the middle of a run scores less than the path without
    labels, for all labels at both ends, the middle has none.
    """
    get = lambda f: crf.w[crf.index[f]] if f in crf.index else np.zeros(crf.t.shape[0])
    gain = lambda v: v - v[..., :1]

    def bound(cues: frozenset[str]) -> np.ndarray:
        names = ["", *sorted(cues)]
        own = np.max([gain(sum(map(get, _own("x", "x", c)))) for c in names], axis=0)
        for k in (-2, -1, 1, 2):
            beside = [gain(get(f"s{k}=x") + get(f"c{k}={c}") + (get("ss=x_x") if k == 1 else get("ps=x_x") if k == -1 else 0)) for c in names]
            own = own + np.max([*beside, gain(get(f"s{k}=#"))], axis=0)
        return own

    def reach(cues: frozenset[str]) -> int | None:
        u, t = bound(cues), crf.t
        left = t.copy()  # best scores from the label before the run to the first word's
        for r in range(most + 1):
            mid = left + u[None]  # r words, then the middle
            right = t.copy()
            for _ in range(r):
                right = (t[:, :, None] + (u[:, None] + right)[None]).max(axis=1)
            none = t[:, :1] + 2 * r * t[0, 0] + t[0][None]
            other = (mid[:, 1:, None] + right[None, 1:]).max(axis=1)
            if (other < none - 1e-6).all():
                return r + 2  # the two words at each end of the run have other neighbours
            left = (left[:, :, None] + u[None, :, None] + t[None]).max(axis=1)
        return None

    best = reach(frozenset())
    if best is None:
        return None
    cues: frozenset[str] = frozenset()
    for c in sorted(_CUES):
        r = reach(cues | {c})
        if r is not None and r <= best + 1:
            cues |= {c}
    return reach(cues), cues


def viterbi(crf: Crf, emissions: list[np.ndarray], batch: int = 256, ends: list[tuple[bool, bool]] | None = None) -> list[np.ndarray]:
    """The likeliest labels of each sequence; sequences of like length share a padded batch.

    ``ends``: whether a token without a label stands before the sequence, and behind it.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
    order = sorted((i for i in range(len(emissions)) if len(emissions[i])), key=lambda i: len(emissions[i]))
    at = 0
    while at < len(order):
        size = max(1, min(batch, 200_000 // len(emissions[order[min(at + batch, len(order)) - 1]])))
        some = order[at : at + size]
        at += size
        lens = np.array([len(emissions[i]) for i in some])
        top = lens.max()
        e = np.zeros((len(some), top, crf.t.shape[0]))
        for r, i in enumerate(some):
            e[r, : lens[r]] = emissions[i]
            if ends is not None and ends[i][0]:
                e[r, 0] += crf.t[0]
            if ends is not None and ends[i][1]:
                e[r, lens[r] - 1] += crf.t[:, 0]
        score, back = e[:, 0].copy(), np.zeros((top, len(some), crf.t.shape[0]), dtype=np.int8)
        for i in range(1, top):
            step = score[:, :, None] + crf.t[None]
            back[i] = step.argmax(axis=1)
            new = step.max(axis=1) + e[:, i]
            live = (i < lens)[:, None]
            score = np.where(live, new, score)
        label = score.argmax(axis=1)
        path = np.zeros((len(some), top), dtype=np.int64)
        for i in range(top - 1, -1, -1):
            path[:, i] = label
            if i:
                label = np.where(i < lens, back[i][np.arange(len(some)), label], label)
        for r, i in enumerate(some):
            out[i] = path[r, : lens[r]]
    return out


# -- patterns: leftmost, non-overlapping within a kind, in linear time -----------------------------------------

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    pos = 0
    at = t.find("@")
    while at >= 0:
        s = at
        while s > pos and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            yield s, m.end()
            pos = m.end()
        at = t.find("@", max(at + 1, pos))


def patterns(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches that hold, by kind and start."""
    out = [(0, s, e) for s, e in _emails(t)]
    if re.search("[0-9]", t):
        for m in _IP.finditer(t):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def _holds(kind: int, s: str) -> bool:
    """What a labelled span must have at least to be one of its kind."""
    d = _digits(s)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", s, re.I) and re.search(r"\.|\bdot\b", s, re.I))
    if kind == 1:
        return bool(_IP.fullmatch(s)) and all(len(p) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15 and len(d) * 2 >= len(s.strip())


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    w = text[start:end]
    return start + len(w) - len(w.lstrip(_EDGE)), start + len(w.rstrip(_EDGE + "."))


def _stretches(texts: list[str], reach: int, cues: frozenset[str]) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[int, int]], bool, bool]]:
    """(text, tokens, the tokens and two neighbours at each side, whether tokens come before, whether behind) of each stretch to decode."""
    start, end, kind = words(texts, cues)
    real = np.flatnonzero(kind != 2)
    start, end, hot = start[real], end[real], np.flatnonzero(kind[real] == 1)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bound = np.searchsorted(start, begin)  # the texts' first tokens
    of = np.searchsorted(bound, hot, side="right") - 1
    for part in np.split(np.arange(len(hot)), np.flatnonzero((np.diff(hot) > 2 * reach) | (np.diff(of) > 0)) + 1):
        if not len(part):
            continue
        i = int(of[part[0]])
        least, most = int(bound[i]), int(bound[i + 1])
        a, b = max(least, int(hot[part[0]]) - reach), min(most, int(hot[part[-1]]) + reach + 1)
        lo, hi, text = max(least, a - 2), min(most, b + 2), texts[i]
        around = [_trimmed(text, x, y) for x, y in zip((start[lo:hi] - begin[i]).tolist(), (end[lo:hi] - begin[i]).tolist(), strict=True)]
        yield i, around[a - lo : b - lo], around, a > least, b < most


def find_spans(texts: list[str], crf: Crf, known: tuple[int, frozenset[str]] | None = None) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """The pattern spans and the added spans of each text, as (kind, start, end). Without ``known``, a ``margin``, all tokens are decoded."""
    base = [patterns(t) for t in texts]
    seqs: list[tuple[int, list[tuple[int, int]]]] = []
    emissions, ends = [], []
    found = _stretches(texts, *known) if known else ((i, k := _tokens(t), k, False, False) for i, t in enumerate(texts))
    for i, toks, around, before, behind in found:
        e = crf.emissions([texts[i][x:y] for x, y in around])  # neighbours are features
        first = min(2, around.index(toks[0])) if before else 0
        emissions.append(e[first : first + len(toks)])
        seqs.append((i, toks))
        ends.append((before, behind))
    labels = viterbi(crf, emissions, ends=ends)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, toks), y in zip(seqs, labels, strict=True):
        k = 0
        while k < len(y):
            j = k
            while j + 1 < len(y) and y[j + 1] == y[k]:
                j += 1
            if y[k]:
                kind, s, e = int(y[k]) - 1, toks[k][0], toks[j][1]
                if _holds(kind, texts[i][s:e]) and not any(s < f and e > g for _, g, f in base[i]):
                    added[i].append((kind, s, e))
            k = j + 1
    return base, [sorted(a) for a in added]


def find_pii(docs: DataFrame, text: str = "text", base: str = "base_spans", added: str = "added_spans") -> DataFrame:
    """``docs`` with two arrays of (k, s, e): spans of the patterns, and spans that the field adds beside them.

    k is the place in ``KINDS``; s and e are code points. A null text counts as empty; repeated rows give a row each; however long texts are
    they are read whole; of labels that score alike the first in ``KINDS`` order counts, none before all. An empty table gives an empty
    table. Columns of ``docs`` named as the two results are replaced, all others pass through.
    """
    ship(docs.sparkSession)
    crf = trained()
    held = docs.sparkSession.sparkContext.broadcast((crf, margin(crf)))
    cols = [c for c in docs.columns if c not in (base, added)]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crf, known = held.value
        as_rows = lambda x: [[{"k": k, "s": s, "e": e} for k, s, e in spans] for spans in x]
        for part in parts:
            b, a = [], []
            for some in pieces(part.tolist()):
                got = find_spans(some, crf, known)
                b += as_rows(got[0])
                a += as_rows(got[1])
            yield pd.DataFrame({"b": b, "a": a})

    kind = "array<struct<k: int, s: int, e: int>>"
    udf = F.pandas_udf(run, f"b {kind}, a {kind}")
    (name,) = free(docs, "p")
    rows = docs.withColumn(name, udf(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return rows.select(*[rows[f"`{c}`"] for c in cols], F.col(f"{name}.b").alias(base), F.col(f"{name}.a").alias(added))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ", ".join(f"'{k}'" for k in KINDS)
    joined = lambda x: f"array_join(transform({x}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')"
    n = [F.expr(f"CAST(size(filter(base_spans, x -> x.k = {i})) AS LONG)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *n, F.sha2(F.expr(joined("base_spans")).cast("binary"), 256).alias("base_sha256"), F.expr(joined("array_sort(concat(base_spans, added_spans))")).alias("spans"))
