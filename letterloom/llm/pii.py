"""Personal data inside free text: a linear-chain conditional random field.

Tokens (words, numbers, single signs) have features of their own shape and spelling; a token's score for a label is
the sum over its own features and those of the two tokens on either side, so that the scores of each distinct token
are computed once per worker and a text is scored by array look-ups. The field is trained here, by gradient ascent on
the exact log-likelihood, from the labelled table of ``pii_table``, and decoded by Viterbi over batches of sequences.
What it finds is then checked exactly: check digits of insurance numbers, the form of numbers, addresses and e-mails.

Defined results: null and empty texts have no findings and stay as they are; spans never overlap; a finding that
fails its check is dropped; very long texts are cut into sequences between tokens, with an overlap that decides alike.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm import pii_table

KINDS = ("email", "telefon", "ahv", "adresse", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Copies of the labelled table, passes over it, step size and weight decay of the training; tokens of one sequence.
COPIES, EPOCHS, RATE, DECAY, LONGEST = 16, 6, 0.05, 1e-4, 400
#: Part of the spelling features that is left out at random in training.
DROPPED = 0.5
REACH = 2
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]|_")
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def marked(text: str) -> list[tuple[str, int, int]]:
    """Tokens with marks (after a zero character) for what their surroundings look like: the form of a number, an e-mail
    or a street, the place in a run of capitalised words and what stands before the run."""
    found = tokens(text)
    marks: list[list[str]] = [[] for _ in found]
    starts = np.array([a for _, a, _ in found], dtype=np.int64)
    for name, pattern in (("mail", _EMAIL), ("phone", _PHONE), ("ahv", _AHV), ("street", _STREET)):
        for m in pattern.finditer(text):
            for k in range(int(np.searchsorted(starts, m.start())), int(np.searchsorted(starts, m.end()))):
                marks[k].append(name)
    capital = lambda w: w[0].isupper() and w.lower() not in _FUNCTION
    i = 0
    while i < len(found):
        if not capital(found[i][0]):
            i += 1
            continue
        run = [i]
        j = i + 1
        while j < len(found) and len(run) < 6:
            w, gap = found[j][0], text[found[j - 1][2] : found[j][1]]
            if capital(w) and gap in (" ", "\n", "") or w == "-" and not gap or w == "." and len(found[j - 1][0]) == 1 or w in _PARTICLES and gap == " " and len(run) < 3:
                if capital(w):
                    run.append(j)
                j += 1
            else:
                break
        at = found[i][1]
        while at and text[at - 1] == " ":
            at -= 1
        before = text[at - 1 : at] if at else ""
        lead = "start" if before in ("", "\n", ".", "!", "?") else "colon" if before == ":" else "comma" if before in ",;" else "mid"
        for n, k in enumerate(run):
            marks[k] += [f"run{min(len(run), 4)}", f"run{min(len(run), 4)}.{n}", f"run{min(len(run), 4)}{lead}"]
        i = max(run[-1] + 1, i + 1)
    return [(w + "\0" + ",".join(m), a, b) if m else (w, a, b) for (w, a, b), m in zip(found, marks, strict=True)]


@lru_cache(maxsize=500_000)
def features(token: str) -> tuple[str, ...]:
    """Features of one token with its marks."""
    token, _, marks = token.partition("\0")
    return (*_plain_features(token), *(f"m{m}" for m in marks.split(",") if m))


def _plain_features(token: str) -> tuple[str, ...]:
    if token.isdigit():
        return ("digits", f"n{min(len(token), 14)}", f"z{token[0] == '0'}", "ahv" if token.startswith("756") and len(token) in (3, 13) else "num", *((f"t{token}",) if token in ("41", "0041", "0", "756") else ()))
    if not token[0].isalpha():
        return ("sign", "t" + token)
    low = token.lower()
    shape = "up" if token.isupper() and len(token) > 1 else "cap" if token[0].isupper() else "low"
    out = ["word", shape, "w" + low, f"l{min(len(token), 6)}", "s3" + low[-3:], "s4" + low[-4:], "s5" + low[-5:], shape + "s4" + low[-4:], shape + "s2" + low[-2:], "p3" + low[:3], "p4" + low[:4], f"{shape}l{min(len(token), 12)}"]
    if re.search(r"(?:strasse|str|weg|gasse|platz|rain|halde|allee|ring|gässli|quai|steig)$", low):
        out.append("street")
    if len(token) == 1:
        out.append(shape + "one")
    return tuple(out)


class Field:
    """Weights: ``w[offset, feature, label]``, ``pair[label, label]``, ``start[label]``."""

    def __init__(self, index: dict[str, int], w: np.ndarray, pair: np.ndarray, start: np.ndarray):
        self.index, self.w, self.pair, self.start = index, w, pair, start
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 2 * REACH + 1, len(LABELS)), dtype=np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Places of the tokens in the table of scores; new ones are scored once."""
        if len(self.known) > 300_000:
            self.known.clear()
        known = self.known
        out = []
        for t in words:
            k = known.get(t)
            if k is None:
                k = known[t] = len(known)
                if k >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                rows = [self.index[f] for f in features(t) if f in self.index]
                self.table[k] = self.w[:, rows].sum(axis=1)
            out.append(k)
        return np.array(out, dtype=np.int64)

    def scores(self, words: list[str]) -> np.ndarray:
        n = len(words)
        at = self.ids(words)
        out = np.zeros((n, len(LABELS)), dtype=np.float32)
        for o in range(-REACH, REACH + 1):
            a, b = max(0, -o), min(n, n - o)
            if a < b:
                out[a:b] += self.table[at[a + o : b + o], o + REACH]
        return out


def viterbi(scores: list[np.ndarray], pair: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Best labels of each sequence; the sequences go through together, the longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    longest = int(sizes[0]) if len(sizes) else 0
    if not longest:
        return [np.empty(0, dtype=np.int64) for _ in scores]
    e = np.zeros((len(order), longest, len(LABELS)), dtype=np.float32)
    for k, i in enumerate(order):
        e[k, : len(scores[i])] = scores[i]
    back = np.zeros(e.shape, dtype=np.int8)
    best = e[:, 0] + start
    final = best.copy()
    for t in range(1, longest):
        m = int(np.searchsorted(-sizes, -t, side="left"))  # sequences longer than t
        way = best[:m, :, None] + pair
        back[:m, t] = way.argmax(axis=1)
        best = way.max(axis=1) + e[:m, t]
        final[:m] = best
    out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(scores)
    for k, i in enumerate(order):
        n = len(scores[i])
        path = np.zeros(n, dtype=np.int64)
        if n:
            path[-1] = int(final[k].argmax())
            for t in range(n - 1, 0, -1):
                path[t - 1] = back[k, t, path[t]]
        out[i] = path
    return out


def _allowed() -> np.ndarray:
    """No inner label without its beginning."""
    bad = np.zeros((len(LABELS), len(LABELS)), dtype=np.float32)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:]:
                    bad[i, j] = -1e4
    return bad


def gold(found: list[tuple[str, int, int]], spans: list[tuple[int, int, str]]) -> list[int]:
    out = []
    for _, a, _b in found:
        span = next((s for s in spans if s[0] <= a < s[1]), None)
        out.append(0 if span is None else LABELS.index(("B-" if a == span[0] or not out or found[len(out) - 1][1] < span[0] else "I-") + span[2]))
    return out


@lru_cache(maxsize=4)
def train(copies: int = COPIES, epochs: int = EPOCHS, seed: int = 11, held_out: bool | None = False) -> Field:
    """The field, trained on the labelled table (without its held-out sentences). The same for the same arguments."""
    data = []
    drop = random.Random(seed)
    index: dict[str, int] = {}
    for text, spans in pii_table.labelled(copies, seed, held_out):
        found = marked(text)
        if not found:
            continue
        rows = []
        for t, _, _ in found:
            # Words themselves are left out at random, so that their form and surroundings have to tell.
            every = [f for f in features(t) if f[0] not in "wsp" or f in ("word", "sign") or drop.random() > DROPPED]
            rows.append([index.setdefault(f, len(index)) for f in every])
        data.append((rows, np.array(gold(found, spans))))
    n, k = len(index), len(LABELS)
    # Beside a token the spelling of its neighbours says little: only their shape, marks and words of several sentences.
    known = Counter(w for x in set(pii_table.SENTENCES) for w in {t.lower() for t, _, _ in tokens(re.sub(r"\{\w+\}", " ", x))})
    known.update({w.lower(): 2 for w in (*pii_table._TITLE, *pii_table._ORG)})
    near = np.array([f[0] not in "sp" and not f.startswith(("capl", "capsf", "lowl", "upl")) and (f[0] != "w" or f == "word" or known[f[1:]] > 1) or f in ("sign", "street") for f in index])
    w = np.zeros((2 * REACH + 1, n, k), dtype=np.float32)
    pair, start = np.zeros((k, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    grown = [np.full(x.shape, 1e-6, dtype=np.float32) for x in (w, pair, start)]
    barred = _allowed()
    rng = np.random.default_rng(seed)
    size = 32
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), size):
            batch = [data[i] for i in order[lo : lo + size]]
            m = max(len(y) for _, y in batch)
            flat_f, flat_t = [], []
            for b, (rows, _) in enumerate(batch):
                for t, fs in enumerate(rows):
                    flat_f += fs
                    flat_t += [b * m + t] * len(fs)
            ff, ft = np.array(flat_f), np.array(flat_t)
            own = np.zeros((2 * REACH + 1, len(batch) * m, k), dtype=np.float32)
            for o in range(2 * REACH + 1):
                np.add.at(own[o], ft, w[o, ff])
            own = own.reshape(2 * REACH + 1, len(batch), m, k)
            e = np.zeros((len(batch), m, k), dtype=np.float32)
            for o in range(-REACH, REACH + 1):
                a, z = max(0, -o), min(m, m - o)
                if a < z:
                    e[:, a:z] += own[o + REACH, :, a + o : z + o]
            live = np.zeros((len(batch), m), dtype=bool)
            y = np.zeros((len(batch), m), dtype=np.int64)
            for b, (_, labels) in enumerate(batch):
                live[b, : len(labels)] = True
                y[b, : len(labels)] = labels
            g_e, g_pair, g_start = _gradient(e, y, live, pair + barred, start)
            # Ascent with a step of its own for each weight.
            g_own = np.zeros_like(own)
            for o in range(-REACH, REACH + 1):
                a, z = max(0, -o), min(m, m - o)
                if a < z:
                    g_own[o + REACH, :, a + o : z + o] += g_e[:, a:z]
            touched = np.unique(ff)
            where = np.searchsorted(touched, ff)
            for o in range(2 * REACH + 1):
                g = np.zeros((len(touched), k), dtype=np.float32)
                np.add.at(g, where, g_own[o].reshape(-1, k)[ft])
                g -= DECAY * w[o, touched]
                grown[0][o, touched] += g * g
                if o != REACH:
                    g[~near[touched]] = 0
                w[o, touched] += RATE * 2 * g / np.sqrt(grown[0][o, touched])
            for x, g, s in ((pair, g_pair, grown[1]), (start, g_start, grown[2])):
                s += g * g
                x += RATE * 2 * g / np.sqrt(s)
        del epoch
    start = start + np.array([-1e4 if x[0] == "I" else 0 for x in LABELS], dtype=np.float32)
    return Field(index, w, pair + barred, start)


def save(field: Field, path: Path = WEIGHTS, least: float = 0.02) -> None:
    """Writes the weights; features that hardly weigh anything are left out."""
    kept = np.flatnonzero(np.abs(field.w).max(axis=(0, 2)) >= least)
    names = np.array(list(field.index), dtype=object)[kept]
    np.savez_compressed(path, features=np.array("\n".join(names)), w=field.w[:, kept].astype(np.float16), pair=field.pair, start=field.start)


@lru_cache(maxsize=2)
def load(path: Path = WEIGHTS) -> Field:
    """The field as trained by ``python -m letterloom.llm.pii``; trained now where the file is absent."""
    if not path.exists():
        return train(held_out=None)
    with np.load(path) as z:
        names = str(z["features"]).split("\n")
        return Field({f: i for i, f in enumerate(names)}, z["w"].astype(np.float32), z["pair"], z["start"])


def _gradient(e: np.ndarray, y: np.ndarray, live: np.ndarray, pair: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood: observed less expected counts, by the forward and backward sums."""
    b, m, k = e.shape
    lse = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
    fore, aft = np.zeros_like(e), np.zeros_like(e)
    fore[:, 0] = e[:, 0] + start
    for t in range(1, m):
        step = lse(fore[:, t - 1, :, None] + pair, 1) + e[:, t]
        fore[:, t] = np.where(live[:, t, None], step, fore[:, t - 1])
    z = lse(fore[:, -1], 1)
    for t in range(m - 2, -1, -1):
        step = lse(pair[None] + (e[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
        aft[:, t] = np.where(live[:, t + 1, None], step, 0)
    last = live.sum(axis=1) - 1
    for i in range(b):
        # Past the end the forward sum repeats the last one.
        fore[i, last[i] + 1 :] = fore[i, last[i]]
    p = np.exp(np.minimum(fore + aft - z[:, None, None], 0)) * live[:, :, None]
    g_e = -p
    rows, cols = np.nonzero(live)
    g_e[rows, cols, y[rows, cols]] += 1
    g_pair = np.zeros_like(pair)
    for t in range(1, m):
        on = live[:, t]
        if on.any():
            joint = np.exp(np.minimum(fore[on, t - 1, :, None] + pair + (e[on, t] + aft[on, t])[:, None, :] - z[on, None, None], 0))
            g_pair -= joint.sum(axis=0)
            np.add.at(g_pair, (y[on, t - 1], y[on, t]), 1)
    g_start = -p[:, 0].sum(axis=0)
    np.add.at(g_start, y[:, 0], 1)
    return g_e, g_pair, g_start


# --- Exact checks of what the field finds ---------------------------------------------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9][\w.+-]*\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.I)
_PHONE = re.compile(r"(?<![\w.+/-])(?:(?:\+|00)41\s?(?:\(0\))?[\s/-]?\d{2}|\(0\d{2}\)|0\d{2})(?:[\s./-]?\d){7}(?![\d]|[./-]\d)")
_AHV = re.compile(r"(?<![\d.])756(?:\.\d{4}\.\d{4}\.\d{2}|\s\d{4}\s\d{4}\s\d{2}|\d{10})(?!\d|[./]\d)")
_NUMBERED = re.compile(r"\s+\d{1,4}\s?[a-zA-Z]?(?![\w])(?!\.\d)")
_TOWN = re.compile(r",?\s+(?:in\s+|à\s+|a\s+)?(?:CH-|CH )?\d{4}\s+[A-ZÄÖÜÉÈ][\w'’-]+(?:\s(?:BE|ZH|SG|AG|VD|TI|GR))?")
# Words that begin the name of a street in French and Italian.
_STREET_FIRST = re.compile(r"(?:rue|avenue|av\.|chemin|ch\.|route|place|quai|boulevard|bd|ruelle|allée|impasse|sentier|via|viale|vicolo|piazza|corso)\s", re.I)
_NUMBER_FIRST = re.compile(r"\d{1,4}\s?[a-zA-Z]?,?\s+(?:rue|avenue|av\.|chemin|ch\.|route|place|quai|boulevard|bd|ruelle|allée|impasse|sentier)(?:\s+(?:de|du|des|la|le|les|l['’]|d['’]))*\s*[^\W\d_][\w'’-]*", re.I)
# Words before or after a name that make it one of an organisation; forms of address.
_ORG_BEFORE = {"stiftung", "verein", "garage", "firma", "restaurant", "bäckerei", "metzgerei", "hotel", "gasthof"}
_ORG_AFTER = {"ag", "gmbh", "sa", "sàrl", "treuhand", "söhne", "co", "genossenschaft", "stiftung"}
_PARTICLES = {"von", "van", "de", "di", "da", "du", "del", "della", "zu", "zur"}
# Small words that are capitalised only where a sentence begins.
_FUNCTION = set("der die das den dem des ein eine einer eines einem einen im in am an auf aus bei beim mit nach nach seit von vom zu zum zur für durch ohne gegen um über unter vor hinter neben zwischen und oder aber auch wie wenn als da dass sie er es wir ich ihr ihre ihren ihrem sein seine unser unsere mein dieser diese dieses bitte wegen während gemäss laut nicht nur noch alle le la les un une des du de et il lo gli una il l the a an and of to for at on with please dear".split())
# Ends of words for streets.
_STREET = re.compile(r"[^\W\d_][\w-]*(?:strasse|str\.|weg|gasse|platz|rain|halde|allee|quai|steig|promenade|matte|hof)\s+\d{1,4}\b|(?:rue|avenue|chemin|route|place|quai|boulevard|ruelle|allée|via|viale|vicolo|piazza)\s[^\d\n.;:]{2,40}?\s\d{1,4}\b|\d{1,4},?\s(?:rue|avenue|chemin|route|place|quai|boulevard|ruelle)\s[^\d\n,.;:]{2,40}", re.I)
_PART_OF_STREET = re.compile(r"(?:alte[rs]?|neue[rs]?|obere[rs]?|untere[rs]?|grosse[rs]?|kleine[rs]?|hintere[rs]?|vordere[rs]?|lange[rs]?)\s+$", re.I)
_ADDRESS_FORMS = {"frau", "herr", "herrn", "madame", "monsieur", "signora", "signor", "familie", "fam", "dr", "prof", "mme", "beistand", "mutter", "vater", "vaters", "schülerin", "schüler", "rechtsanwalt", "rechtsanwältin", "pfarrer", "direktor", "direktorin"}


def valid_ahv(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()]
    return len(d) == 13 and (10 - sum(x * (3 if i % 2 else 1) for i, x in enumerate(d[:12])) % 10) % 10 == d[12]


def _overlapping(pattern: re.Pattern, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text, max(0, a - 60), min(len(text), b + 60)):
        if m.start() < b and m.end() > a:
            yield m.span()


def checked(text: str, kind: str, a: int, b: int) -> list[tuple[int, int]]:
    """The spans that hold against the exact form of their kind, around what the field found."""
    if kind == "email":
        return list(_overlapping(_EMAIL, text, a, b))
    if kind == "telefon":
        return list(_overlapping(_PHONE, text, a, b))
    if kind == "ahv":
        return [s for s in _overlapping(_AHV, text, a, b) if valid_ahv(text[s[0] : s[1]])]
    if kind == "adresse":
        return _address(text, a, b)
    return _names(text, a, b)


def _address(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Street and number in either order, then postcode and town where they follow."""
    if m := re.search(r"(?<![\w.])" + _STREET_FIRST.pattern + r"[^\d\n.,;:]{0,25}$", text[max(0, a - 40) : a], re.I):
        a = max(0, a - 40) + m.start()
    elif (m := _STREET.match(text, a)) is None and (m := _STREET.search(text, a, b + 6)) and not _PART_OF_STREET.search(text[a : m.start()]):
        a = m.start()  # what stands before the street, such as the word address, is none of it
    before = re.search(r"(?<![\w.,/-])\d{1,4}\s?[a-zA-Z]?,?\s+$", text[max(0, a - 9) : a])
    if before and _STREET_FIRST.match(text, a):
        a -= len(before.group())
    if m := _NUMBER_FIRST.match(text, a):
        end = m.end()
    else:
        # Small words before the street don't belong to it; a street that begins in small letters is one of another language.
        while (m := re.match(r"(?:an|in|bei|der|die|das|dem|den|am|im|zur|zum|auf|neu|à|au|la|le|nach)\s+", text[a:b])) and not _STREET_FIRST.match(text, a):
            a += m.end()
        m = re.match(r"[^\d\n]*[^\W\d_][^\d]*?(?=\s+\d)|[^\d]+$", text[a:b])
        if not m:
            return []
        n = _NUMBERED.match(text, a + m.end())
        if not n:
            return []
        end = n.end()
    if t := _TOWN.match(text, end):
        end = t.end()
    return [(a, end)]


def _names(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The names in a span: without forms of address, whole at hyphens, one for each of several persons, and none where
    the words beside make it an organisation's."""
    while m := re.search(r"[^\W\d_]+-$", text[max(0, a - 30) : a]):
        a -= len(m.group())
    while m := re.match(r"-[^\W\d_]+", text[b : b + 30]):
        b += len(m.group())
    words = [t for t in tokens(text[a:b]) if t[0][0].isalpha()]
    # A comma divides persons where two words or more stand before it; else it follows a surname.
    groups: list[list[tuple[str, int, int]]] = [[]]
    for w in words:
        if groups[-1] and "," in text[a + groups[-1][-1][2] : a + w[1]] and sum(len(x[0]) > 1 for x in groups[-1]) >= 2 and not all("-" in text[a + x[2] : a + y[1]] for x, y in zip(groups[-1], groups[-1][1:], strict=False)):
            groups.append([])
        groups[-1].append(w)
    out = []
    for own in groups:
        titled = False
        while len(own) > 1 and own[0][0].lower() in _ADDRESS_FORMS:
            own, titled = own[1:], True
        # Small words at either end are no part of a name, but for those that begin a surname.
        while own and own[-1][0][0].islower():
            own = own[:-1]
        while own and own[0][0][0].islower() and own[0][0] not in _PARTICLES:
            own = own[1:]
        if not own or not any(w[0][0].isupper() and len(w[0]) > 1 for w in own):
            continue
        start, end = a + own[0][1], a + own[-1][2]
        before = [t[0].lower() for t in tokens(text[max(0, start - 40) : start])][-2:]
        after = [t[0].lower() for t in tokens(text[end : end + 30])][:2]
        if before and before[-1] in _ORG_BEFORE or after and (after[0] in _ORG_AFTER or after[0] in "&+"):
            continue
        if sum(w[0] not in _PARTICLES for w in own) == 1 and not titled and not set(before) & _ADDRESS_FORMS:
            continue
        out.append((start, end))
    return out


def find(texts: list[str], field: Field) -> list[list[tuple[int, int, str]]]:
    """(begin, end, kind) of the personal data in each text, in order."""
    pieces: list[tuple[int, list[tuple[str, int, int]]]] = []
    for i, text in enumerate(texts):
        found = marked(text)
        for at in range(0, max(len(found), 1), LONGEST - 50):
            if part := found[at : at + LONGEST]:
                pieces.append((i, part))
            if at + LONGEST >= len(found):
                break
    spans: list[set[tuple[int, int, str]]] = [set() for _ in texts]
    for lo in range(0, len(pieces), 256):
        part = pieces[lo : lo + 256]
        paths = viterbi([field.scores([t[0] for t in p]) for _, p in part], field.pair, field.start)
        for (i, p), path in zip(part, paths, strict=True):
            at = 0
            while at < len(path):
                label = LABELS[path[at]]
                if label == "O":
                    at += 1
                    continue
                stop = at + 1
                while stop < len(path) and LABELS[path[stop]] == "I-" + label[2:]:
                    stop += 1
                spans[i].update((a, b, label[2:]) for a, b in checked(texts[i], label[2:], p[at][1], p[stop - 1][2]))
                at = stop
    out = []
    for own in spans:
        kept: list[tuple[int, int, str]] = []
        for a, b, kind in sorted(own, key=lambda s: (KINDS.index(s[2]), -(s[1] - s[0]), s[0])):
            if all(b <= x or a >= y for x, y, _ in kept):
                kept.append((a, b, kind))
        out.append(sorted(kept))
    return out


#: Placeholders by kind.
PLACEHOLDER = {"email": "[E-MAIL]", "telefon": "[TELEFON]", "ahv": "[AHV]", "adresse": "[ADRESSE]", "name": "[NAME]"}


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def personal_data(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, maskiert, funde): each row's text with placeholders and what was found (art, fund, von, bis).

    The trained weights are read on the driver and sent to the workers (their size is that of the table's features)."""
    field = load()
    shared = df.sparkSession.sparkContext.broadcast((field.index, field.w, field.pair, field.start))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for batch in batches:
            own = own or Field(*shared.value)
            texts = [t if isinstance(t, str) else None for t in batch["text"].tolist()]
            rows = find([t or "" for t in texts], own)
            yield pd.DataFrame({
                "id": batch["id"],
                "text": texts,
                "maskiert": [None if t is None else masked(t, s) for t, s in zip(texts, rows, strict=True)],
                "funde": [[{"art": k, "fund": " ".join(t[a:b].split()), "von": a, "bis": b} for a, b, k in s] if t else [] for t, s in zip(texts, rows, strict=True)],
            })

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id long, text string, maskiert string, funde array<struct<art:string,fund:string,von:int,bis:int>>")


if __name__ == "__main__":
    save(train(held_out=None))
