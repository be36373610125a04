"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags tokens as begin, inside or outside of a secret. A token's features come from its
shape, the shapes and trigger words of two tokens before and one after it, whether a trigger word is
among the REACH tokens before it, and from the file. It is
fitted with numpy by maximum likelihood on lines of a bounded sample of texts, labelled by the
patterns. What the patterns cannot say is taught by copies of these lines: one with the values redrawn
from other alphabets, lengths and forms (signed tokens in parts, prefixed keys) behind other trigger
words and separators, still secret; one with the trigger words gone and dates, versions, numbers, paths
or short codes in the values' place, not secret. Lines are separate chains, decoded by Viterbi; for
fitting, a long line is cut into consecutive windows, whose tokens keep the features of their
neighbours beyond the cut. All tokens get exact scores by table look-up; a line in which no token's
gain over "outside" can be positive, whatever the transitions, is all outside, and only the other lines
need the decoder.

Bounds of the sample, all parameters of `train`: `max_marked` and `max_plain` texts with and without a
pattern match, and of their windows (`window` tokens each) `max_windows` of each of three kinds: with a
value, without one but with a digit, and with neither; copies of windows come on top of the first. All are
drawn by hashes. Everything else reads all rows and whole texts.

Pattern spans always stay; decoded spans of ADDED_LEAST code points or more that touch none of them are
added as kind crf. Spans count
code points, end exclusive. Defined results: null and empty texts have no spans; a table without
any pattern match gives a model that adds nothing; repeated rows get equal results (and count once for
the sample); texts and lines of any length are scanned whole; an empty table gives no rows; other
columns, whatever they are called, are not read by `scan` and pass through `redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import kth_smallest, text_or_empty, written

# The patterns of the scan and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS, ASSIGN_LEAST = ("password", "passwd", "secret", "token", "api"), 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 with its beginning; runs are maximal, so this equals filtering them
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

TRIGGERS = frozenset("password passwd pwd secret token key apikey api_key auth bearer credential credentials access private login pass".split())
TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s]")
MAX_MARKED, MAX_PLAIN, MAX_WINDOWS, WINDOW, COPIES, STEPS, WORDS_KEPT, GROUP_CHARS = 1000, 600, 2000, 80, 4, 120, 200_000, 1_500_000
ADDED_LEAST = 8  # code points of a span that the field adds, as in the first pattern
O, B, I = 0, 1, 2
NEWLINE, EDGE, NEAR, REACH = "newline", "edge", ("near none", "near trigger"), 6


def pattern_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def signature(token: str) -> str:
    """The discrete shape of a token, from which its features are read."""
    low = token.lower()
    if low in TRIGGERS:
        return f"trigger {low}"
    if len(token) == 1 and not token.isalnum():
        return f"sign {token if token in '=:,.;@/|-_+#' else 'quote' if token in chr(34) + chr(39) + '`' else 'other'}"
    n = len(token)
    size = sum(n >= k for k in (4, 8, 12, 16, 24, 32, 48))
    if token.isalpha():
        case = "low" if token.islower() else "up" if token.isupper() else "title" if token[0].isupper() and token[1:].islower() else "mixed"
        return f"letters {case} {size}"
    core = re.sub(r"[+/_.\-]", "", token)
    inner = "plain" if core == token else "dotted" if "." in token else "joined"
    if core.isdigit():
        return f"digits {inner} {size}"
    hexa = "hex" if re.fullmatch(r"[0-9a-f]+", core) else "any"
    switches = sum(a != b for a, b in zip(map(_class, core), map(_class, core[1:])))
    lower, upper = any(c.islower() for c in core), any(c.isupper() for c in core)
    digit = any(c.isdigit() for c in core)
    return f"mix {inner} {size} {hexa} {'l' * lower}{'u' * upper}{'d' * digit} {min(3, 8 * switches // max(1, n))}"


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2


def _features(sig: str) -> list[str]:
    parts = sig.split(" ")
    return ["bias", sig, parts[0], *[f"{parts[0]}/{k}/{x}" for k, x in enumerate(parts[1:])], *([f"size/{parts[2]}"] if parts[0] in ("mix", "digits", "letters") else [])]


def file_signature(triggers: bool, equals: bool, tokens: int) -> str:
    return f"file {triggers:d} {equals:d} {min(4, len(str(tokens)))}"


def near_trigger(trigger: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether one of the REACH tokens before each is a trigger word; line holds where each token's line begins."""
    at = np.arange(len(trigger))
    sums = np.concatenate([[0], np.cumsum(trigger)])
    return sums[at] > sums[np.maximum(at - REACH, line)]


class Crf:
    """Weights by place (own, before, two before, after, a trigger word near, file), feature and tag; transitions; start."""

    PLACES = ("own", "before", "before2", "after", "near", "file")

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = {p: np.zeros((0, 3)) for p in self.PLACES}
        self.trans = np.zeros((3, 3))
        self.start = np.zeros(3)
        self.trans[O, I] = self.start[I] = -1e4  # no inside without a begin
        self._ids: dict[str, int] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._tables: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_ids": {}, "_words": {}, "_tables": {}}

    # fitting -------------------------------------------------------------------------------------

    def fit(self, windows: list["Window"], steps: int = STEPS, rate: float = 0.15, l2: float = 3e-5, balance: float = 0.5) -> "Crf":
        """Adam over all windows; those of about the same length are taken together, time first.

        Windows with a value, where they are few, weigh `balance` times as much together as the others.
        """
        windows = sorted((x for x in windows if x.tags), key=lambda x: (len(x.tags), x))
        if not any(B in x.tags for x in windows):
            return self
        sigs = sorted({s for x in windows for s in x.signatures} | {x.file for x in windows} | {EDGE, *NEAR})
        at = {s: k for k, s in enumerate(sigs)}
        self.index = {f: k for k, f in enumerate(sorted({f for s in sigs for f in _features(s)}))}
        x = np.zeros((len(sigs), len(self.index)))
        for s, k in at.items():
            x[k, [self.index[f] for f in _features(s)]] = 1
        groups, begin = [], 0
        for k, w in enumerate(windows):
            if k + 1 == len(windows) or len(windows[k + 1].tags) > 1.3 * len(windows[begin].tags) + 2:
                groups.append(_group(windows[begin : k + 1], at))
                begin = k + 1
        marked = sum(B in x.tags for x in windows)
        heavy = max(1.0, balance * (len(windows) - marked) / marked)
        n, size, classes, places = marked * heavy + len(windows) - marked, len(self.index), len(sigs), len(self.PLACES)
        theta = np.zeros(places * size * 3 + 12)
        shut = np.zeros(12)
        shut[O * 3 + I] = shut[9 + I] = -1e4
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            w = theta[:-12].reshape(places, size, 3)
            tables = {p: x @ w[k] for k, p in enumerate(self.PLACES)}
            trans, start = (theta[-12:-3] + shut[:9]).reshape(3, 3), theta[-3:] + shut[9:]
            grad = np.zeros_like(theta)
            by_class = np.zeros((places, classes, 3))
            for g in groups:
                weight = np.where(g.marked, heavy, 1.0)
                unary = sum(tables[p][c] for p, c in zip(self.PLACES, g.codes)) + tables["file"][g.file]
                marginal, pairs = _marginals(unary, trans, start, g.mask, weight)
                miss = (g.one - marginal * g.mask[:, :, None]) * weight[:, None]
                for tag in range(3):
                    one_tag = np.ascontiguousarray(miss[:, :, tag]).ravel()
                    for k, c in enumerate(g.codes):
                        by_class[k, :, tag] += np.bincount(c.ravel(), one_tag, classes)
                    by_class[-1, :, tag] += np.bincount(g.file, miss[:, :, tag].sum(0), classes)
                grad[-12:-3] += (np.einsum("lna,lnb,n->ab", g.one[:-1], g.one[1:], weight) - pairs).ravel()
                grad[-3:] += miss[0].sum(0)
            grad[:-12] = (x.T @ by_class).ravel()
            grad = -grad / n + l2 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = theta[:-12].reshape(places, size, 3)
        self.weights = {p: w[k].copy() for k, p in enumerate(self.PLACES)}
        self.trans, self.start = (theta[-12:-3] + shut[:9]).reshape(3, 3), theta[-3:] + shut[9:]
        return self

    # decoding ------------------------------------------------------------------------------------

    def _id(self, sig: str) -> int:
        """Number of a signature in the tables of this process; tables grow as shapes turn up."""
        k = self._ids.get(sig)
        if k is None:
            k = self._ids[sig] = len(self._ids)
            known = [self.index[f] for f in _features(sig) if f in self.index]
            for p in self.PLACES:
                row = self.weights[p][known].sum(0)[None] if known else np.zeros((1, 3))
                self._tables[p] = np.concatenate([self._tables.get(p, np.zeros((0, 3))), row])
        return k

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Signature numbers of the tokens of a piece between white space."""
        found = self._words.get(word)
        if found is None:
            found = (self._id(signature(word)),) if word.isalpha() else (self._id(NEWLINE),) if word == "\n" else tuple(self._id(signature(t)) for t in TOKEN.findall(word))
            if len(self._words) < WORDS_KEPT:
                self._words[word] = found
        return found

    def unary(self, ids: np.ndarray, file: int) -> np.ndarray:
        """Scores of the tokens of one line."""
        edge = self._id(EDGE)
        padded = np.concatenate([[edge, edge], ids, [edge]])
        far, near = map(self._id, NEAR)
        names = list(self._ids)
        close = near_trigger(np.array([names[i].startswith("trigger") for i in ids], bool), np.zeros(len(ids), np.int64))
        t = self._tables
        return t["own"][ids] + t["before"][padded[1:-2]] + t["before2"][padded[:-3]] + t["after"][padded[3:]] + t["near"][np.where(close, near, far)] + t["file"][file]

    def viterbi(self, unary: np.ndarray) -> list[int]:
        score = self.start + unary[0]
        back = np.zeros((len(unary), 3), np.int64)
        for k in range(1, len(unary)):
            step = score[:, None] + self.trans
            back[k] = step.argmax(0)
            score = step.max(0) + unary[k]
        tags = [int(score.argmax())]
        for k in range(len(unary) - 1, 0, -1):
            tags.append(int(back[k, tags[-1]]))
        return tags[::-1]

    def doubtful(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each text the numbers of its lines that may hold a secret, and its file signature.

        The bound adds to a token's own gain the most that the transitions at its two sides can give.
        """
        edge, newline, far, near = map(self._id, (EDGE, NEWLINE, *NEAR))
        split = [x.replace("\n", " \n ").split(" ") for x in texts]
        flat = pa.array([w for ws in split for w in ws], pa.large_string()).dictionary_encode()
        words = [self.word_ids(w) for w in flat.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        every = np.fromiter((i for w in words for i in w), np.int64, int(sizes.sum()))
        code = np.asarray(flat.indices).astype(np.int64)
        n = sizes[code]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = every[np.repeat((np.cumsum(sizes) - sizes)[code] - before[:-1], n) + np.arange(before[-1])]
        bounds = before[np.concatenate([[0], np.cumsum([len(ws) for ws in split])])]
        is_end = ids == newline
        sigs = list(self._ids)
        trigger = np.array([s.startswith("trigger") for s in sigs])[ids]
        equals = np.array([s == "sign =" for s in sigs])[ids]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        files = [file_signature(a > 0, b > 0, int(c)) for a, b, c in zip(sums(trigger), sums(equals), np.diff(bounds) - sums(is_end))]
        file_ids = np.array([self._id(f) for f in files], np.int64)
        t = {p: np.stack([x[:, B] - x[:, O], x[:, I] - x[:, O]], 1) for p, x in self._tables.items()}
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        shown = np.where(is_end, edge, ids)  # beyond its line a token sees the edge
        first = np.zeros(len(ids) + 1, bool)
        first[bounds] = True
        first = first[:-1]
        prev = np.where(first, edge, np.concatenate([[edge], shown[:-1]])[: len(ids)])
        prev2 = np.where(first | (prev == edge), edge, np.concatenate([[edge], prev[:-1]])[: len(ids)])
        last = np.zeros(len(ids) + 1, bool)
        last[bounds] = True
        nxt = np.where(last[1:], edge, np.concatenate([shown[1:], [edge]])[: len(ids)])
        begin = np.maximum.accumulate(np.where(first | (prev == edge), np.arange(len(ids)), 0))  # of the token's line
        close = np.where(near_trigger(trigger, begin), near, far)
        gain = (t["own"][ids] + t["before"][prev] + t["before2"][prev2] + t["after"][nxt] + t["near"][close] + t["file"][file_ids][owner]).max(1)
        free = np.concatenate([self.trans.ravel(), self.start])
        side = max(0.0, float(free.max() - self.trans[O, O]), float(self.start.max() - self.start[O]))
        line = np.cumsum(is_end) - is_end  # numbered over all texts
        base = np.concatenate([[0], np.cumsum(is_end)])[bounds[:-1]]
        out: list[tuple[list[int], str]] = [([], f) for f in files]
        hit = np.flatnonzero((gain + 2 * side > 0) & ~is_end)
        for k, number in dict.fromkeys(zip(owner[hit].tolist(), (line[hit] - base[owner[hit]]).tolist())):
            out[k][0].append(number)
        return out

    def decode(self, text: str, numbers: list[int], file: str) -> list[tuple[int, int]]:
        """Spans in the given lines of a text."""
        out, lines, begins = [], text.split("\n"), [0]
        for x in lines:
            begins.append(begins[-1] + len(x) + 1)
        for k in numbers:
            tokens = list(TOKEN.finditer(lines[k]))
            tags = self.viterbi(self.unary(np.array([self._id(signature(m[0])) for m in tokens]), self._id(file)))
            for m, tag in zip(tokens, tags):
                if tag == B:
                    out.append((begins[k] + m.start(), begins[k] + m.end()))
                elif tag == I:
                    out[-1] = (out[-1][0], begins[k] + m.end())
        return [(s, e) for s, e in out if e - s >= ADDED_LEAST]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        if not self.index:
            return [[] for _ in texts]
        out, group, size = [], [], 0
        for k, text in enumerate(texts):
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS or k == len(texts) - 1:
                out += [self.decode(x, *found) if found[0] else [] for x, found in zip(group, self.doubtful(group))]
                group, size = [], 0
        return out


class Window(NamedTuple):
    """Tokens of a line: their signatures with those of two tokens before and one after, whether a trigger
    word is near, their tags, the file's signature."""

    signatures: list[str]
    near: list[bool]
    tags: list[int]
    file: str


class _Group(NamedTuple):
    """Windows of about the same length as arrays, time first."""

    codes: tuple[np.ndarray, ...]  # signature numbers at the places own, before, before2, after, near
    file: np.ndarray
    mask: np.ndarray
    one: np.ndarray
    marked: np.ndarray


def _group(windows: list[Window], at: dict[str, int]) -> _Group:
    n, length = len(windows), len(windows[-1].tags)
    code, near = np.full((length + 3, n), at[EDGE]), np.full((length, n), at[NEAR[0]])
    tag, mask = np.zeros((length, n), int), np.zeros((length, n), bool)
    for k, w in enumerate(windows):
        code[: len(w.signatures), k] = [at[s] for s in w.signatures]
        near[: len(w.tags), k] = [at[NEAR[x]] for x in w.near]
        tag[: len(w.tags), k], mask[: len(w.tags), k] = w.tags, True
    one = np.eye(3)[tag] * mask[:, :, None]
    return _Group((code[2:-1], code[1:-2], code[:-3], code[3:], near), np.array([at[w.file] for w in windows]), mask, one, (tag == B).any(0))


def _marginals(unary, trans, start, mask, weight=None):
    """Tag probabilities of each token, and (weighted) expected counts of tag pairs, by forward and backward sums.

    Arrays run over time first; sums are scaled to 1 at every token, so that nothing under- or overflows.
    """
    length, n, _ = unary.shape
    e, t, s = np.exp(unary - unary.max(2, keepdims=True)), np.exp(trans), np.exp(start)
    forward, scale = np.empty_like(e), np.ones((length, n, 1))
    for k in range(length):
        step = (s if not k else forward[k - 1] @ t) * e[k]
        scale[k] = step.sum(1, keepdims=True)
        forward[k] = step / scale[k]
    backward, pairs = np.ones_like(e), np.zeros((3, 3))
    for k in range(length - 1, 0, -1):
        after = np.where(mask[k, :, None], e[k] * backward[k] / scale[k], 0)
        pairs += (forward[k - 1] if weight is None else forward[k - 1] * weight[:, None]).T @ after
        backward[k - 1] = np.where(mask[k, :, None], after @ t.T, 1)
    return forward * backward, pairs * t


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def drawn_secret(rng: random.Random, n: int) -> str:
    """A value of about n characters in a form that the patterns need not know."""
    text = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    form = rng.randrange(6)
    if form == 0:
        return text(_LOWER + _UPPER + _DIGITS, n)
    if form == 1:
        return text(_LOWER + _DIGITS, n)
    if form == 2:
        return text("ABCDEF" + _DIGITS, n)
    if form == 3:  # a prefixed key
        return "_".join([text(_LOWER, rng.randrange(2, 5)), *([text(_LOWER, 4)] * rng.randrange(2)), text(_LOWER + _UPPER + _DIGITS, n)])
    if form == 4:  # a signed token in parts
        return ".".join(text(_LOWER + _UPPER + _DIGITS + "-_", k) for k in (n // 2 + 4, n, n))
    return text(_LOWER + _UPPER + _DIGITS + "+/-", n)


def drawn_plain(rng: random.Random) -> str:
    """What mixes signs, letters and digits and is no secret: a date, time, version, number, path or short code."""
    number = lambda a, b: str(rng.randrange(a, b))
    word = lambda: "".join(rng.choices(_LOWER, k=rng.randrange(3, 9)))
    return rng.choice([
        lambda: f"{number(1900, 2100)}-{number(10, 13)}-{number(10, 29)}", lambda: f"v{number(0, 20)}.{number(0, 20)}.{number(0, 99)}", lambda: number(1, 10 ** rng.randrange(1, 13)),
        lambda: "/".join([word(), word(), word() + number(0, 99)]), lambda: "".join(rng.choices(_UPPER, k=rng.randrange(1, 4))) + number(1, 10**5), lambda: f"{word()}-{word()}.{word()}", lambda: word() + number(0, 2030),
    ])()


def training_windows(text: str, seed: int, window: int = WINDOW, copies: int = COPIES) -> list[Window]:
    """The tagged windows of a text; those with values come with so many copies of both kinds (see above)."""
    values = sorted({(v, e) for _, e, _, v in pattern_spans(text)})
    tokens = TOKEN.findall(text)
    file = file_signature(any(t.lower() in TRIGGERS for t in tokens), "=" in tokens, len(tokens))
    triggers, rng, out, at = sorted(TRIGGERS), random.Random(seed), [], 0
    for line in text.split("\n"):
        words, tags, held = [], [], None
        for m in TOKEN.finditer(line):
            inside = next(((v, e) for v, e in values if v <= at + m.start() and at + m.end() <= e), None)
            words.append(m[0])
            tags.append(O if inside is None else I if inside == held else B)
            held = inside
        at += len(line) + 1
        out += _windows(words, tags, file, window)
        for secret in (True, False) * copies if B in tags else ():
            copied, kept, bare = [], [], False
            for w, t in zip(words, tags):
                if t == I or bare and w in "'\"":  # a value without an opening sign has no closing one
                    continue
                bare = False
                if t == O:
                    if secret and w.lower() in TRIGGERS and rng.random() < 0.3:  # two of them, as in "access key"
                        copied.append(rng.choice(triggers))
                        kept.append(O)
                    copied.append(w if w.lower() not in TRIGGERS else rng.choice(triggers) if secret else "".join(rng.choices(_LOWER, k=5)))
                elif secret:
                    while copied and copied[-1] in "=:'\"" or len(copied) > 1 and copied[-1] == "is":
                        copied.pop()
                        kept.pop()
                    form = rng.choice([(), ("=",), (":",), ("=", ">"), ("is",), (":", '"'), ("=", "'"), ("=", ">", '"')])
                    if not copied or copied[-1].lower() not in TRIGGERS:
                        form = (rng.choice(triggers), *form)
                    form = form or (copied.pop(),)
                    kept = kept[: len(copied)]
                    copied += [*form, drawn_secret(rng, rng.randrange(16, 49))]
                    kept += [O] * len(form)
                    bare = form[-1] not in "'\""
                else:
                    copied.append(drawn_plain(rng))
                kept.append(t if secret else O)
            out += [x for x in _windows(copied, kept, file, window) if not secret or B in x.tags]
    return out


def _windows(words: list[str], tags: list[int], file: str, window: int) -> list[Window]:
    """A line in consecutive windows; a value that a cut would part goes on in the next one as its beginning."""
    sigs = [EDGE, EDGE, *map(signature, words), EDGE]
    near = near_trigger(np.array([s.startswith("trigger") for s in sigs[2:-1]], bool), np.zeros(len(words), np.int64)).tolist()
    tags = [B if t == I and k % window == 0 else t for k, t in enumerate(tags)]
    return [Window(sigs[k : k + window + 3], near[k : k + window], tags[k : k + window], file) for k in range(0, len(words), window)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_marked: int = MAX_MARKED, max_plain: int = MAX_PLAIN, max_windows: int = MAX_WINDOWS, window: int = WINDOW, steps: int = STEPS) -> Crf:
    """Fits the field on a bounded sample of texts with and without pattern matches, and of their windows.

    Both are drawn by hashes of the id and the text; only the windows' shapes and tags come to the driver.
    """
    text = text_or_empty(text_col)
    texts = docs.select(text.alias("text"), F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), text), F.lit(5)), F.lit(1 << 62)).alias("draw"))
    marked = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}") | F.col("text").rlike("AKIA[A-Z0-9]{12}") | F.col("text").rlike("[0-9a-f]{32}")
    n = max(1, docs.agg(F.approx_count_distinct(id_col) + F.count_if(F.col(id_col).isNull())).first()[0])
    # A first cut by the share that is wanted (marked texts are looked for among 60 times as many), then an exact one.
    share = lambda k: F.col("draw") < int(min(1, k / n) * (1 << 62))
    pool = texts.where(share(60 * max_marked)).groupBy("draw").agg(F.min("text").alias("text")).withColumn("marked", marked)  # rows that repeat an id count once
    sample = written(pool.where(F.col("marked") | share(1.3 * max_plain)))
    chosen = sample.limit(0)
    for kind, most in ((F.col("marked"), max_marked), (~F.col("marked"), max_plain)):
        mine = sample.where(kind)
        last = kth_smallest(mine, "draw", most)
        chosen = chosen if last is None else chosen.unionByName(mine.where(F.col("draw") <= last))
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("line", T.ArrayType(T.StringType())), T.StructField("near", T.ArrayType(T.BooleanType())), T.StructField("tags", T.ArrayType(T.IntegerType())), T.StructField("file", T.StringType())])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for text, seed in zip(batch["text"].to_pylist(), batch["draw"].to_pylist()) for x in training_windows(text, seed, window)]
            kinds = [0 if B in x.tags else 1 if any(s.startswith(("mix", "digits")) for s in x.signatures) else 2 for x in rows]
            at = [int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=7).digest()) for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(at, pa.int64()), pa.array([x.signatures for x in rows], pa.list_(pa.string())), pa.array([x.near for x in rows], pa.list_(pa.bool_())), pa.array([x.tags for x in rows], pa.list_(pa.int32())), pa.array([x.file for x in rows], pa.string())], names=schema.names)

    tagged = written(chosen.mapInArrow(tag, schema))
    windows = []
    for kind, most in ((0, 2 * max_windows), (1, max_windows), (2, max_windows)):  # those with a value and their copies
        windows += tagged.where(F.col("kind") == kind).orderBy("at").limit(most).collect()
    return Crf().fit([Window(list(r["line"]), list(r["near"]), list(r["tags"]), r["file"]) for r in windows], steps)


def found_spans(texts: list[str], crf: Crf) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, by start and kind."""
    out = []
    for text, added in zip(texts, crf.spans(texts)):
        fixed = [(s, e, k) for s, e, k, _ in pattern_spans(text)]
        free = [(s, e, "crf") for s, e in added if not any(s < y and x < e for x, y, _ in fixed)]
        out.append(sorted(fixed + free, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found (kind, start, end), by start and then by kind, for every row; no shuffle."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("found", SPAN)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": s, "end": e} for s, e, k in spans] for spans in found_spans(batch["text"].to_pylist(), crf)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, kind)], names=schema.names)

    return slim.mapInArrow(work, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts by pattern, the hash of the pattern spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.filter("found", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def redact(docs: DataFrame, crf: Crf, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every span of its texts replaced by mask; all columns stay (n_chars follows the text)."""
    at, schema = docs.columns.index(text_col), docs.schema
    counted = [k for k, f in enumerate(schema.fields) if f.name == "n_chars" and isinstance(f.dataType, T.LongType)]

    def cut(text: str, spans: list[tuple[int, int, str]]) -> str:
        parts, end = [], 0
        for s, e, _ in spans:
            if s >= end:
                parts += [text[end:s], mask]
            end = max(end, e)
        return "".join(parts) + text[end:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            spans = found_spans(["" if x is None else x for x in old], crf)
            new = [cut(x, s) if s else x for x, s in zip(old, spans)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            for k in counted:
                columns[k] = pa.array([len(x) if s else n for x, s, n in zip(new, spans, columns[k].to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(work, schema)
